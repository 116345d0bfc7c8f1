import oracle
import pytest

from tidegate import run_queries

pytestmark = pytest.mark.skipif(not oracle.there(), reason="the small tables aren't here")


@pytest.mark.parametrize("name", sorted(run_queries.QUERIES))
def test_run_equals_its_sql(spark, name):
    oracle.same(spark, run_queries.QUERIES[name], run_queries.ORACLE_SQL[name])
