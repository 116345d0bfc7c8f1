"""The registered queries of the operators, with DuckDB SQL where it can express them.

A query applies its operator to its whole table and derives digests from what the operator returns.
"""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, html, langid, license_scan, line_dedup, near_dup, packing, quality
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Near(words=4))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_all(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, a table with a row a turn, and conversation -7, a record, whose texts hold the
    template's own marks; both layouts are found by their fingerprints."""
    turns = chat.turns_from_table(table(spark, sf_dir, "conversations"))
    text = r"\### Assistant: </turn> ok"
    trial = json.dumps({"messages": [{"role": role, "content": text} for role in ("user", "assistant")]})
    record = chat.turns_from_records(spark.createDataFrame([(-7, trial)], "conv_id long, record string")).drop("fingerprint")
    return chat.digests(chat.format_turns(turns.union(record)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE)
    tokens = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_dup, op2_license_scan, op3_fingerprint, op4_quality_rules, op5_line_dedup, op6_html, op7_packing, op8_chat_format, op9_language_id, op10_bpe)}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op1_near_dup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT doc_id, any_value(n.n)::BIGINT AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""
ORACLE_SQL["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(o.n >= 2 AND o.owner != k.doc_id, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
ORACLE_SQL["op2_license_scan"] = license_scan.scan_all_sql()
ORACLE_SQL["op8_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
c AS (SELECT conv_id, turn, role = 'assistant' AS learned, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
n AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x))), 0) AS body,
length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x))), 0) + length(role) - length(replace(role, ':', '')) + length(role) - length(replace(role, chr(10), '')) AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (learned), '')) AS loss_sha256, sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars FROM n GROUP BY conv_id
"""
