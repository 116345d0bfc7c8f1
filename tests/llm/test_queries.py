import oracle
import pytest

from tidegate.llm import queries

pytestmark = pytest.mark.skipif(not oracle.there(), reason="the small tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_columns_of_the_contracts(spark):
    want = {
        "op3_fingerprint": ["doc_id bigint", "n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"],
        "op4_quality_rules": ["doc_id bigint", "n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint", "base_failed boolean", "kept boolean"],
        "op9_language_id": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
        "op10_bpe": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
        "op7_packing": ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"],
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, oracle.SF)
        assert [f"{c} {t}" for c, t in df.dtypes][: len(columns)] == columns, name
        assert df.count() >= 200
