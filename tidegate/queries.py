"""Queries that apply the engine's operators to the driver's tables, each with DuckDB SQL.

The tables are clean, so what is bad in them is derived from keys, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casts, masks, names, selectors
from .operators import checks, merge, mismatch, policy, report, unique

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text and typed columns, in files of 1000 ids: every tenth has no user, every
    seventh no number as value."""
    e = table(spark, sf_dir, "events")
    user = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    place = [F.floor(F.col("event_id") / 1000).cast("long").alias(checks.FILE_ORD), (F.col("event_id") % 1000).alias(checks.ROW)]
    return e.select("event_id", user.alias("user_id"), "event_type", raw.alias("raw_value"), casts.typed(raw, "int64").alias("value"), *place)


_DIRTY = """e AS (SELECT event_id, CASE WHEN event_id % 10 != 0 THEN user_id END AS user_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS raw_value, CASE WHEN event_id % 7 != 0 THEN event_id END AS value, event_id // 1000 AS file_ord FROM events)"""


def checked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dirty_events with their errors: required user, value a number, (user, type) unique."""
    e = unique.with_duplicates(dirty_events(spark, sf_dir), ["user_id", "event_type"], ["event_id"], "__dup")
    return e.withColumn(checks.ERRORS, checks.row_errors(["user_id"], [("raw_value", "value")], [("__dup", "[user_id,event_type]")]))


_CHECKED = _DIRTY + """, c AS (SELECT *, user_id IS NULL AS n, value IS NULL AS k, user_id IS NOT NULL AND row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS d FROM e)"""


# --- row checks -----------------------------------------------------------------------------------
@query(f"WITH {_DIRTY} SELECT event_id, 'not_null' AS rule, 'user_id' AS \"column\", 'required value missing' AS message FROM e WHERE user_id IS NULL")
def not_null_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dirty_events(spark, sf_dir)
    return e.select("event_id", checks.not_null_error("user_id").alias("e")).where("e IS NOT NULL").select("event_id", "e.*")


@query(f"WITH {_DIRTY} SELECT file_ord, count(*) FILTER (user_id IS NULL) AS violations, count(*) AS n_rows FROM e GROUP BY file_ord")
def not_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dirty_events(spark, sf_dir)
    return e.groupBy(F.col(checks.FILE_ORD).alias("file_ord")).agg(F.count_if(F.col("user_id").isNull()).alias("violations"), F.count("*").alias("n_rows"))


def _order_text() -> Column:
    price = F.floor(F.col("o_totalprice")).cast("long").cast("string")
    return F.when(F.col("o_orderkey") % 7 == 0, F.concat(price, F.lit("x"))).when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(price)


_ORDER_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN floor(o_totalprice)::BIGINT || 'x' WHEN o_orderkey % 11 = 0 THEN NULL ELSE (floor(o_totalprice)::BIGINT)::VARCHAR END"


@query(f"WITH r AS (SELECT o_orderkey, {_ORDER_TEXT} AS raw FROM orders) SELECT o_orderkey, raw, 'invalid value for target type' AS message FROM r WHERE raw IS NOT NULL AND TRY_CAST(raw AS BIGINT) IS NULL")
def cast_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderkey", _order_text().alias("raw"))
    r = r.withColumn("price", casts.typed(F.col("raw"), "integer"))
    return r.select("o_orderkey", "raw", checks.cast_error("raw", "price").alias("e")).where("e IS NOT NULL").select("o_orderkey", "raw", "e.message")


@query(f"SELECT o_orderkey, TRY_CAST({_ORDER_TEXT} AS BIGINT)::VARCHAR AS price FROM orders")
def cast_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", casts.typed(_order_text(), "int64").cast("string").alias("price"))


_DATES = ["concat('2024-02-', lpad(cast(event_id % 32 as string), 2, '0'))", "concat('2024-1-', cast(event_id % 9 + 1 as string))", "'2024'"]


@query("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2024-02-' || lpad((event_id % 32)::VARCHAR, 2, '0') WHEN 1 THEN '2024-1-' || (event_id % 9 + 1) ELSE '2024' END AS raw FROM events)
SELECT event_id, raw, CASE WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(raw AS DATE)::VARCHAR END AS day FROM r""")
def cast_date_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(f"case event_id % 3 when 0 then {_DATES[0]} when 1 then {_DATES[1]} else {_DATES[2]} end")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), casts.typed(raw, "date").cast("string").alias("day"))


@query("""WITH r AS (SELECT event_id, ['true', ' FALSE ', '1', '0', 'yes', 'T'][event_id % 6 + 1] AS raw FROM events)
SELECT event_id, CASE WHEN lower(trim(raw)) IN ('true', '1') THEN true WHEN lower(trim(raw)) IN ('false', '0') THEN false END AS flag FROM r""")
def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("true", " FALSE ", "1", "0", "yes", "T")])
    return table(spark, sf_dir, "events").select("event_id", casts.typed(F.get(words, (F.col("event_id") % 6).cast("int")), "bool").alias("flag"))


@query("SELECT p_partkey, CASE WHEN p_size * 10 - 100 BETWEEN 0 AND 255 THEN p_size * 10 - 100 END::VARCHAR AS small, CASE WHEN p_size - 20 BETWEEN 0 AND 65535 THEN p_size - 20 END::VARCHAR AS middle FROM part")
def uint_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", casts.typed(text(F.col("p_size") * 10 - 100), "uint8").cast("string").alias("small"), casts.typed(text(F.col("p_size") - 20), "uint16").cast("string").alias("middle"))


# --- uniqueness -----------------------------------------------------------------------------------
@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS duplicate FROM events")
def unique_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return unique.with_duplicates(e, ["user_id"], ["event_id"], "duplicate")


@query("""WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 3 != 0 THEN event_type END AS kind FROM events)
SELECT event_id, user_id, kind, kind IS NOT NULL AND row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) > 1 AS duplicate FROM r""")
def unique_composite_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"))
    return unique.with_duplicates(e, ["user_id", "kind"], ["event_id"], "duplicate")


@query(f"WITH {_DIRTY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) > 1 AS d FROM e) SELECT event_id FROM r WHERE value IS NOT NULL AND user_id IS NOT NULL AND NOT d")
def unique_rejected_first_claims_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = checks.split(checked_events(spark, sf_dir))
    return accepted.select("event_id")


@query("""WITH r AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 != 0), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 OR EXISTS (SELECT 1 FROM s WHERE s.o_custkey = r.o_custkey) AS duplicate FROM r""")
def unique_append_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return unique.with_duplicates(o.where("o_orderkey % 4 != 0"), ["o_custkey"], ["o_orderkey"], "duplicate", seed=o.where("o_orderkey % 4 = 0"))


@query("WITH g AS (SELECT text, count(*) - 1 AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) SELECT coalesce(sum(n), 0)::BIGINT AS duplicates, count(*) AS affected_keys FROM g")
def unique_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unique.unique_stats(unique.with_duplicates(d, ["text"], ["doc_id"], "dup"), ["text"], "dup")


@query("SELECT user_id || ',' || event_type AS key, count(*) - 1 AS duplicates FROM events GROUP BY user_id, event_type HAVING count(*) > 1 ORDER BY duplicates DESC, key LIMIT 5")
def unique_top_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = unique.with_duplicates(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"], "dup")
    return unique.unique_samples(e, ["user_id", "event_type"], "dup")


# --- the whole check and its formats --------------------------------------------------------------
@query(f"WITH {_CHECKED} SELECT event_id, sha256(user_id::VARCHAR) AS user_hash, event_type, value FROM c WHERE NOT (n OR k OR d)")
def check_pipeline_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = checks.split(checked_events(spark, sf_dir))
    named = accepted.select("event_id", F.col("user_id").cast("string").alias("user_hash"), "event_type", "value")
    return masks.mask(named, {"user_hash": ("hash", None)})


_ERRORS = {
    "n": ("not_null", "user_id", "required value missing"),
    "k": ("cast_error", "value", "invalid value for target type"),
    "d": ("unique", "[user_id,event_type]", "duplicate key"),
}
_TEXT = "'\"' || concat_ws('; ', " + ", ".join(f"CASE WHEN {f} THEN '{r}:{c} {m}' END" for f, (r, c, m) in _ERRORS.items()) + ") || '\"'"
_JSON = "'[' || concat_ws(',', " + ", ".join(f"""CASE WHEN {f} THEN '{{"rule":"{r}","column":"{c}","message":"{m}"}}' END""" for f, (r, c, m) in _ERRORS.items()) + ") || ']'"
_CSV = "'\"' || concat_ws('\\n', " + ", ".join(f"CASE WHEN {f} THEN '{r},{c},{m}' END" for f, (r, c, m) in _ERRORS.items()) + ") || '\"'"


def _formatted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    _, rejected = checks.split(checked_events(spark, sf_dir))
    return rejected.select("event_id", checks.format_errors(F.col(checks.ERRORS), kind).alias("errors"))


@query(f"WITH {_CHECKED} SELECT event_id, {_TEXT} AS errors FROM c WHERE n OR k OR d")
def errors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(spark, sf_dir, "text")


@query(f"WITH {_CHECKED} SELECT event_id, {_JSON} AS errors FROM c WHERE n OR k OR d")
def errors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(spark, sf_dir, "json")


@query(f"WITH {_CHECKED} SELECT event_id, {_CSV} AS errors FROM c WHERE n OR k OR d")
def errors_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(spark, sf_dir, "csv")


@query(f"WITH {_CHECKED} SELECT event_id, user_id::VARCHAR AS user_id, value::VARCHAR AS value, n::INT + k::INT + d::INT AS n_errors FROM c WHERE n OR k OR d")
def check_pipeline_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = checks.split(checked_events(spark, sf_dir))
    return rejected.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("value").cast("string").alias("value"), F.size(checks.ERRORS).alias("n_errors"))


# --- severities -----------------------------------------------------------------------------------
@query(f"WITH {_CHECKED} SELECT event_id, value::VARCHAR AS value, n::INT + k::INT + d::INT AS n_errors FROM c")
def severity_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.route(checked_events(spark, sf_dir), "warn").accepted.select("event_id", F.col("value").cast("string").alias("value"), F.size(checks.ERRORS).alias("n_errors"))


def _late_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in some files only, the first of them not the first file."""
    e = dirty_events(spark, sf_dir)
    return e.withColumn(checks.ERRORS, F.when((F.col(checks.FILE_ORD) >= 3) & (F.col(checks.FILE_ORD) % 2 == 1), checks.row_errors(["user_id"], [("raw_value", "value")])).otherwise(checks.gathered([])))


_LATE = _DIRTY + ", b AS (SELECT min(file_ord) AS stop FROM e WHERE file_ord >= 3 AND file_ord % 2 = 1 AND (user_id IS NULL OR value IS NULL))"


@query(f"WITH {_LATE} SELECT event_id, CASE WHEN file_ord = (SELECT stop FROM b) THEN 'rejected' ELSE 'accepted' END AS outcome FROM e WHERE file_ord <= coalesce((SELECT stop FROM b), 9223372036854775807)")
def severity_abort_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.route(_late_errors(spark, sf_dir), "abort")
    return out.accepted.select("event_id", F.lit("accepted").alias("outcome")).union(out.rejected.select("event_id", F.lit("rejected").alias("outcome")))


@query(f"""WITH {_DIRTY}, f AS (SELECT file_ord, max(value IS NULL) AS cast_failed FROM e GROUP BY file_ord)
SELECT event_id, CASE WHEN cast_failed THEN (value IS NULL)::INT ELSE (user_id IS NULL)::INT + (value IS NULL)::INT END AS n_errors FROM e JOIN f USING (file_ord)""")
def abort_only_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dirty_events(spark, sf_dir).withColumn(checks.ERRORS, checks.row_errors(["user_id"], [("raw_value", "value")]))
    return policy.only_casts_where_aborted(e).select("event_id", F.size(checks.ERRORS).alias("n_errors"))


@query(f"WITH {_CHECKED} SELECT event_id FROM c WHERE NOT d")
def merge_pk_forced_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.route(checked_events(spark, sf_dir), "warn", forced=F.col("__dup")).accepted.select("event_id")


# --- schemas and names ----------------------------------------------------------------------------
@query("SELECT c_custkey, c_name, NULL::BIGINT AS loyalty, NULL::VARCHAR AS note FROM customer")
def schema_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mismatch.apply_mismatch(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_custkey": "int64", "c_name": "string", "loyalty": "integer", "note": "text"})


@query("SELECT c_custkey, c_name FROM customer")
def schema_drop_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mismatch.apply_mismatch(table(spark, sf_dir, "customer"), {"c_custkey": "int64", "c_name": "string"})


@query("SELECT c_custkey AS customer_id, c_name AS full_name2, c_acctbal AS acct_bal_usd FROM customer")
def normalize_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Customer ID"), F.col("c_name").alias("fullName2"), F.col("c_acctbal").alias("Acct-BalUSD"))
    return raw.toDF(*names.normalize_all(raw.columns, "snake_case"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def json_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", selectors.select_json(value, "k")[0].alias("k"), selectors.select_json(value, "z.y[0]")[0].alias("missing"))


@query("SELECT event_id, event_type AS kind, '{\"t\":\"' || event_type || '\"}' AS whole, true AS is_container FROM events")
def json_selector_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_parse_json(F.concat(F.lit('{"a":[{"t":"'), F.col("event_type"), F.lit('"}]}')))
    whole, container = selectors.select_json(value, "a[0]")
    return table(spark, sf_dir, "events").select("event_id", selectors.select_json(value, "a[0].t")[0].alias("kind"), whole.alias("whole"), container.alias("is_container"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey AS key, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL")
def fixed_width_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.fixed import slices

    line = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, " "), F.col("l_returnflag"), F.lit("  "))
    cells = slices(F.col("line"), [("key", 12, True), ("flag", 3, True)])
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")).select("l_orderkey", "l_linenumber", *cells)
    return out.groupBy("l_orderkey", "l_linenumber", casts.typed(F.col("key"), "int64").alias("key"), "flag").agg(F.count("*").alias("n"))


# --- masking --------------------------------------------------------------------------------------
def _masked(rule: tuple[str, str | None]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return masks.mask(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": rule, "absent": rule})

    return run


for _name, _rule, _sql in (
    ("pii_hash", ("hash", None), "sha256(c_name)"),
    ("pii_redact", ("redact", None), "'[REDACTED]'"),
    ("pii_nullify", ("nullify", None), "NULL::VARCHAR"),
    ("pii_mask", ("mask", "{first4}****{last4}"), "left(c_name, greatest(0, least(4, length(c_name) - 4))) || '****' || right(c_name, 4)"),
    ("pii_mask_short", ("mask", "{first9}-{last15}"), "left(c_name, greatest(0, least(9, length(c_name) - least(15, length(c_name))))) || '-' || right(c_name, 15)"),
):
    QUERIES[_name] = _masked(_rule)
    ORACLE_SQL[_name] = f"SELECT c_custkey, {_sql} AS c_name FROM customer"
QUERIES["pii_drop"], ORACLE_SQL["pii_drop"] = _masked(("drop", None)), "SELECT c_custkey FROM customer"


# --- merges ---------------------------------------------------------------------------------------
def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old orders, and new ones: half of them changed, some as they were, some new."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 != 0")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return old, o.where("o_orderkey % 3 != 1").withColumn("o_totalprice", price).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))


_VERSIONS = """t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 != 0),
s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 != 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 != 1)"""
_KEY = ["o_orderkey"]


@query(f"WITH {_VERSIONS} SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def scd1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.scd1(*_versions(spark, sf_dir), _KEY)


@query(f"WITH {_VERSIONS} SELECT o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, CASE WHEN t.o_custkey IS NOT NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM t FULL JOIN s USING (o_orderkey)")
def scd1_ignore_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.scd1(*_versions(spark, sf_dir), _KEY, ignore=["o_orderstatus"])


@query(f"WITH {_VERSIONS} SELECT count(*) FILTER (t.o_custkey IS NULL) AS inserted, count(*) FILTER (t.o_custkey IS NOT NULL AND s.o_custkey IS NOT NULL) AS updated, count(t.o_custkey) AS rows_before, count(*) AS rows_after FROM t FULL JOIN s USING (o_orderkey)")
def scd1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.scd1_metrics(*_versions(spark, sf_dir), _KEY)


_NOW, _FIRST = "timestamp_ntz'2026-01-02 03:04:05'", "timestamp_ntz'2025-01-01 00:00:00'"
_CHANGED = "(t.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR t.o_totalprice IS DISTINCT FROM s.o_totalprice)"


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a history, every eighth of them closed already."""
    old, new = _versions(spark, sf_dir)
    past = merge.history(old, F.expr(_FIRST))
    closed = F.col("o_orderkey") % 8 == 0
    return past.withColumn("__dq_is_current", ~closed).withColumn("__dq_valid_to", F.when(closed, F.expr(_FIRST))), new


_HISTORY = _VERSIONS + """, h AS (SELECT *, o_orderkey % 8 != 0 AS cur, CASE WHEN o_orderkey % 8 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' END AS until FROM t)"""


def _scd2_sql(differs: str) -> str:
    return f"""WITH {_HISTORY}, j AS (SELECT t.*, s.o_orderkey IS NOT NULL AND t.cur AND {differs} AS shut FROM h t LEFT JOIN s USING (o_orderkey)),
i AS (SELECT s.* FROM s LEFT JOIN (SELECT * FROM h WHERE cur) t USING (o_orderkey) WHERE t.o_custkey IS NULL OR {differs})
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cur AND NOT shut AS __dq_is_current, '2025-01-01 00:00:00' AS __dq_valid_from, CASE WHEN shut THEN '2026-01-02 03:04:05' ELSE until::VARCHAR END AS __dq_valid_to FROM j
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, true, '2026-01-02 03:04:05', NULL FROM i"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("__dq_valid_from", "__dq_valid_to")})


@query(_scd2_sql(_CHANGED))
def scd2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _history(spark, sf_dir)
    return _shown(merge.scd2(target, source, _KEY, merge.compare_columns(source, _KEY), F.expr(_NOW)))


@query(_scd2_sql("t.o_totalprice IS DISTINCT FROM s.o_totalprice"))
def scd2_compare_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _history(spark, sf_dir)
    return _shown(merge.scd2(target, source, _KEY, merge.compare_columns(source, _KEY, ignore=["o_orderstatus"]), F.expr(_NOW)))


@query(f"WITH {_HISTORY}, j AS (SELECT t.o_custkey IS NULL AS fresh, t.o_custkey IS NOT NULL AND {_CHANGED} AS diff FROM s LEFT JOIN (SELECT * FROM h WHERE cur) t USING (o_orderkey)) SELECT count(*) FILTER (fresh OR diff) AS inserted, count(*) FILTER (diff) AS closed, count(*) FILTER (NOT fresh AND NOT diff) AS unchanged, (SELECT count(*) FROM h) AS rows_before, (SELECT count(*) FROM h) + count(*) FILTER (fresh OR diff) AS rows_after FROM j")
def scd2_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _history(spark, sf_dir)
    return merge.scd2_metrics(target, source, _KEY, merge.compare_columns(source, _KEY))


@query("SELECT c_custkey, c_name, NULL::VARCHAR AS segment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def additive_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return merge.append(c.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), c.where("c_custkey % 2 = 1").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment")), "add_columns")


# --- sinks and reports ----------------------------------------------------------------------------
@query("SELECT o_orderkey, date_diff('year', TIMESTAMP '1970-01-01', o_orderdate)::INT AS o_orderdate_year, date_diff('month', TIMESTAMP '1970-01-01', o_orderdate)::INT AS o_orderdate_month, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate)::INT AS o_orderdate_day, date_diff('hour', TIMESTAMP '1970-01-01', o_orderdate)::INT AS o_orderdate_hour FROM orders")
def partition_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sinks.partitions import transform

    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[transform("o_orderdate", kind) for kind in ("year", "month", "day", "hour")])


@query(f"WITH {_CHECKED} SELECT count(*) AS \"rows\", count(*) FILTER (NOT (n OR k OR d)) AS accepted, count(*) FILTER (n OR k OR d) AS rejected, sum(n::INT + k::INT + d::INT)::BIGINT AS violations FROM c")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(checked_events(spark, sf_dir))


@query(f"WITH {_CHECKED} SELECT file_ord, count(*) AS \"rows\", count(*) FILTER (NOT (n OR k OR d)) AS accepted, count(*) FILTER (n OR k OR d) AS rejected FROM c GROUP BY file_ord")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_counts(checked_events(spark, sf_dir)).withColumnRenamed(checks.FILE_ORD, "file_ord")


@query(f"WITH {_CHECKED} SELECT file_ord, 'not_null' AS rule, 'user_id' AS \"column\", count(*) AS violations FROM c WHERE n GROUP BY file_ord UNION ALL SELECT file_ord, 'cast_error', 'value', count(*) FROM c WHERE k GROUP BY file_ord UNION ALL SELECT file_ord, 'unique', '[user_id,event_type]', count(*) FROM c WHERE d GROUP BY file_ord")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_summary(checked_events(spark, sf_dir)).withColumnRenamed(checks.FILE_ORD, "file_ord")


@query(None)
def xml_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are well-formed as XML: their language and title."""
    from .sources.xml import select_xml

    return select_xml(table(spark, sf_dir, "pages"), "html", "head", {"title": "title", "charset": "meta/@charset"}, keep=["page_id"])
