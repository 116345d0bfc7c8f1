import oracle
import pytest

from tidegate import queries

pytestmark = pytest.mark.skipif(not oracle.there(), reason="the small tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_xml_selector_reads_every_page(spark):
    rows = queries.xml_selector(spark, oracle.SF).collect()
    pages = oracle.connect().sql("SELECT count(*) FROM pages").fetchall()[0][0]
    assert len({r.page_id for r in rows}) == pages
