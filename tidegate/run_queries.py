"""Queries that go through whole runs: the driver's tables are written as files of each format, a contract
is run over them, and what the run left is read back.

The orders are spoilt alike in both engines: every tenth has no customer, every seventh no number, and
every eleventh a note with a separator, quotes and a line break.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.config import Config, build, validate
from .plans.run import EntityReport, run
from .session import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KINDS = {"key": "integer", "cust": "integer", "number": "integer", "status": "string", "note": "string"}
WIDTHS = {"key": 12, "cust": 10, "number": 12, "status": 1, "note": 16}
PLAIN, ODD = "o_orderpriority", "CASE WHEN o_orderkey % 11 = 0 THEN 'a;\"b' || chr(10) || o_orderpriority ELSE o_orderpriority END"


def good(note: str = PLAIN, where: str = "o_orderkey % 10 != 0 AND o_orderkey % 7 != 0") -> str:
    """SQL of the rows that are accepted."""
    return f"SELECT o_orderkey AS key, o_custkey AS cust, o_orderkey * 3 + 1 AS number, o_orderstatus AS status, {note} AS note FROM orders WHERE {where}"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def raw_orders(spark: SparkSession, sf_dir: str, odd: bool = False) -> DataFrame:
    """All cells as text; no customer is null. file: which of four files the row is for."""
    o, key = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    note = F.when(key % 11 == 0, F.concat(F.lit('a;"b\n'), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority")) if odd else F.col("o_orderpriority")
    number = F.when(key % 7 == 0, "n/a").otherwise((key * 3 + 1).cast("string"))
    return o.select(key.cast("string").alias("key"), F.when(key % 10 != 0, F.col("o_custkey").cast("string")).alias("cust"), number.alias("number"), F.col("o_orderstatus").alias("status"), note.alias("note"), (key % 4).alias("file"))


def _documents(rows: DataFrame, item: Column, first: str, between: str, last: str) -> DataFrame:
    """The lines of a document a file, an item each; no task holds a document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, begun = first, False
        for part in parts:
            if lines := part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *[between + x for x in lines[1:]]], pa.string())], names=["value"])
                before, begun = between, True
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last])], names=["value"])

    return rows.repartitionById(4, F.col("file").cast("int")).select(item.alias("value")).mapInArrow(run, "value string")


def write_files(rows: DataFrame, kind: str, path: str, mode: str = "overwrite") -> None:
    """The rows as files of the format."""
    cells = [F.col(c) for c in KINDS]
    rows, many = rows.repartition(4, "file"), rows
    match kind:
        case "csv" | "tsv":
            rows.select(*cells).write.mode(mode).options(sep=";" if kind == "csv" else "\t", header=True, escape='"', emptyValue="").csv(path)
        case "fixed":
            rows.select(F.concat(*[F.rpad(F.coalesce(c, F.lit("")), w, " ") for c, w in zip(cells, WIDTHS.values(), strict=True)]).alias("value")).write.mode(mode).text(path)
        case "json":
            _documents(many, F.to_json(F.struct(*cells)), "[", ",", "]").write.mode(mode).text(path)
        case "ndjson":
            rows.select(*cells).write.mode(mode).json(path)
        case "xml":
            tags = [F.concat(F.lit(f"<{n}>"), F.coalesce(c, F.lit("")), F.lit(f"</{n}>")) for n, c in zip(KINDS, cells, strict=True)]
            _documents(many, F.concat(F.lit("<o>"), *tags, F.lit("</o>")), "<orders>", "", "</orders>").write.mode(mode).text(path)
        case _:
            rows.select(*cells).write.mode(mode).format(kind).save(path)


class Job:
    """A contract over one folder of files, run as often as asked."""

    def __init__(self, spark: SparkSession, kind: str = "csv", columns: dict[str, str] | None = None, **entity: Any):
        self.spark, self.top, self.kind = spark, workspace(spark), kind
        options = {"glob": "part-*", **({"json_mode": "ndjson"} if kind == "ndjson" else {"row_tag": "o"} if kind == "xml" else {}), **entity.pop("options", {})}
        accepted = {"format": "parquet", "path": f"{self.top}/accepted", **entity.pop("accepted", {})}
        sink = {"accepted": accepted, "rejected": {"format": "csv", "path": f"{self.top}/rejected"}, "write_mode": entity.pop("write_mode", "overwrite")}
        own = [{"name": n, "type": k, **({"nullable": False} if n == "cust" else {}), **({"width": WIDTHS[n]} if kind == "fixed" else {}), **({"unique": True} if n in entity.get("unique", ()) else {})} for n, k in (columns or KINDS).items()]
        entity.pop("unique", None)
        self.entity = {"name": "orders", "source": {"format": "json" if kind == "ndjson" else kind, "path": f"{self.top}/in", "options": options}, "sink": sink, "policy": {"severity": entity.pop("severity", "reject")}, "schema": {"columns": own, **entity.pop("schema", {})}, **entity}

    def config(self) -> Config:
        out = build(Config, {"version": "0.1", "report": {"path": f"{self.top}/report"}, "entities": [self.entity]}, "config")
        validate(out)
        return out

    def run(self, **options: Any) -> EntityReport:
        self.outcome = run(self.spark, "queries", config=self.config(), **options)
        done = self.outcome.entities[0]
        if done.status == "failed":
            raise RuntimeError(done.notes[0])
        return done

    def write(self, rows: DataFrame, mode: str = "overwrite") -> Job:
        write_files(rows, self.kind, f"{self.top}/in", mode)
        return self

    def accepted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.top}/accepted")


def _format(kind: str, odd: bool) -> None:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        job = Job(spark, kind).write(raw_orders(spark, sf_dir, odd))
        job.run()
        return job.accepted()

    one.__name__ = f"ingest_{kind}"
    query(good(ODD if odd else PLAIN))(one)


for _kind, _odd in {"csv": True, "tsv": True, "fixed": False, "json": True, "ndjson": True, "xml": False, "parquet": True, "orc": True}.items():
    _format(_kind, _odd)


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 7 = 0 THEN 'not_null cust,cast_error number' WHEN o_orderkey % 10 = 0 THEN 'not_null cust' ELSE 'cast_error number' END AS errors FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0")
def ingest_rejected_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = Job(spark).write(raw_orders(spark, sf_dir, True))
    job.run()
    rows = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{job.top}/rejected")
    errors = F.from_json("__dq_errors", "array<struct<rule:string,column:string,message:string>>")
    return rows.select(F.col("key").cast("long").alias("key"), F.array_join(F.transform(errors, lambda e: F.concat_ws(" ", e["rule"], e["column"])), ",").alias("errors"))


@query("SELECT rule, count(*) AS n FROM (SELECT 'not_null' AS rule FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'cast_error' FROM orders WHERE o_orderkey % 7 = 0) GROUP BY rule")
def ingest_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = Job(spark, severity="warn").write(raw_orders(spark, sf_dir))
    found = spark.read.json(job.run().errors_path)
    errors = F.from_json("errors", "array<struct<rule:string,column:string,message:string>>")
    return found.select(F.explode(errors).alias("e")).groupBy(F.col("e.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("SELECT 'rejected' AS status, 0 AS exit_code, count(*) AS rows, count(*) FILTER (o_orderkey % 10 != 0 AND o_orderkey % 7 != 0) AS accepted, count(*) FILTER (o_orderkey % 10 = 0 OR o_orderkey % 7 = 0) AS rejected, count(*) FILTER (o_orderkey % 10 = 0) + count(*) FILTER (o_orderkey % 7 = 0) AS errors FROM orders")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that the run wrote."""
    job = Job(spark).write(raw_orders(spark, sf_dir))
    job.run(run_id="r")
    found = json.loads("".join(r[0] for r in spark.read.text(f"{job.top}/report/run_r/orders/run.json", wholetext=True).collect()))
    row = (found["status"], job.outcome.exit_code, *[found[k] for k in ("rows", "accepted", "rejected", "errors")])
    return spark.createDataFrame([row], "status string, exit_code int, rows long, accepted long, rejected long, errors long")


@query(good(where="o_orderkey % 10 != 0 AND o_orderkey % 7 != 0 AND o_orderkey % 4 = 1"))
def ingest_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files; the second has errors, so the rows of the first alone are written."""
    rows = raw_orders(spark, sf_dir)
    clean = "key % 10 != 0 AND number != 'n/a'"
    job = Job(spark, severity="abort", options={"recursive": True})
    for folder, own in (("a", rows.where(f"file = 1 AND {clean}")), ("b", rows.where("file = 2")), ("c", rows.where(f"file = 3 AND {clean}"))):
        own.select(*KINDS).coalesce(1).write.options(sep=";", header=True).csv(f"{job.top}/in/{folder}")
    job.run()
    return job.accepted()


_APPENDED = f"WITH g AS ({good()}) SELECT key, cust, number + CASE WHEN key % 4 = 3 THEN 1 ELSE 0 END AS number, status, note FROM g WHERE key % 4 IN (1, 2, 3)"


def _append(spark: SparkSession, sf_dir: str, accepted: dict[str, Any], **more: Any) -> Job:
    """Two batches: files 1 and 2, then 2 and 3, with other numbers; keys that are there are refused."""
    rows = raw_orders(spark, sf_dir)
    job = Job(spark, unique=("key",), write_mode="append", accepted=accepted, **more).write(rows.where("file IN (1, 2)"))
    job.run()
    again = F.when(F.col("number") != "n/a", (F.col("number").cast("long") + 1).cast("string")).otherwise(F.col("number"))
    job.write(rows.where("file IN (2, 3)").withColumn("number", again))
    job.last = job.run()
    return job


@query(_APPENDED)
def ingest_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append(spark, sf_dir, {}).accepted()


@query(_APPENDED)
def ingest_append_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sinks.tables import VersionedTable

    job = _append(spark, sf_dir, {"format": "versioned"})
    return VersionedTable(spark, f"{job.top}/accepted").read()


@query(_APPENDED)
def ingest_append_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    from .sinks.tables import DuckDbTable

    path = f"{tempfile.mkdtemp(prefix='tidegate-')}/t.duckdb"  # the driver's own file
    _append(spark, sf_dir, {"format": "duckdb", "path": path, "duckdb": {"table": "orders"}})
    return DuckDbTable(spark, path, "orders").keys(list(KINDS))


@query("SELECT count(*) FILTER (o_orderkey % 4 = 2 AND o_orderkey % 7 != 0 AND o_orderkey % 10 != 0) AS target_duplicates, 0 AS batch_duplicates, 'reject_rows' AS effect FROM orders")
def ingest_unique_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _append(spark, sf_dir, {}).last.unique[0]
    return spark.createDataFrame([(u["target_duplicates"], u["batch_duplicates"], u["effect"])], "target_duplicates long, batch_duplicates int, effect string")


_SCD1 = f"WITH g AS ({good()}) SELECT key, cust, CASE WHEN key % 4 = 1 THEN number ELSE number + 1 END AS number, status, note FROM g WHERE key % 4 IN (1, 2, 3)"
_SCD2 = f"WITH g AS ({good()}) SELECT key, number, current, closed FROM (SELECT key, number, key % 4 = 1 AS current, key % 4 = 2 AS closed FROM g WHERE key % 4 IN (1, 2) UNION ALL SELECT key, number + 1, true, false FROM g WHERE key % 4 IN (2, 3))"


def _merged(spark: SparkSession, sf_dir: str, mode: str, sink: str) -> DataFrame:
    import tempfile

    from .sinks.tables import DuckDbTable, VersionedTable

    rows = raw_orders(spark, sf_dir).where("key % 10 != 0 AND number != 'n/a'")
    path = f"{tempfile.mkdtemp(prefix='tidegate-')}/t.duckdb" if sink == "duckdb" else f"{workspace(spark)}/t"
    accepted = {"format": sink, "path": path, **({"duckdb": {"table": "orders"}} if sink == "duckdb" else {})}
    job = Job(spark, write_mode=mode, accepted=accepted, schema={"primary_key": ["key"]}).write(rows.where("file IN (1, 2)"))
    job.run()
    job.write(rows.where("file IN (2, 3)").withColumn("number", (F.col("number").cast("long") + 1).cast("string")))
    job.run()
    if sink == "versioned":
        return VersionedTable(spark, path).read()
    return DuckDbTable(spark, path, "orders").keys([*KINDS, *(["__dq_is_current", "__dq_valid_to"] if mode == "merge_scd2" else [])])


def _history(df: DataFrame) -> DataFrame:
    return df.select("key", "number", F.col("__dq_is_current").alias("current"), F.col("__dq_valid_to").isNotNull().alias("closed"))


@query(_SCD1)
def ingest_scd1_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "merge_scd1", "versioned")


@query(_SCD1)
def ingest_scd1_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "merge_scd1", "duckdb")


@query(_SCD2)
def ingest_scd2_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(_merged(spark, sf_dir, "merge_scd2", "versioned"))


@query(_SCD2)
def ingest_scd2_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(_merged(spark, sf_dir, "merge_scd2", "duckdb"))


@query(f"SELECT *, CASE WHEN key % 4 IN (0, 1) THEN 1 ELSE 2 END AS run FROM ({good()})")
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the ledger knows are skipped: each run appends the rows of the files that are new."""
    rows = raw_orders(spark, sf_dir)
    job = Job(spark, incremental_mode="file", write_mode="append").write(rows.where("file IN (0, 1)"))
    first = job.run()
    before = job.accepted().select("key")
    before = spark.createDataFrame(before.toArrow()).withColumn("run", F.lit(1))
    second = job.write(rows.where("file IN (2, 3)"), "append").run()
    if {f.path for f in first.files} & {f.path for f in second.files}:
        raise RuntimeError("a file was read twice")
    return job.accepted().join(before, "key", "left").withColumn("run", F.coalesce("run", F.lit(2)))


@query(f"SELECT key, sha256(cust::VARCHAR) AS cust, left(status, 1) || '*' AS status, '[REDACTED]' AS note FROM ({good()})")
def ingest_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pii = [{"name": "cust", "strategy": "hash"}, {"name": "number", "strategy": "drop"}, {"name": "status", "strategy": "mask", "mask_pattern": "{first1}*"}, {"name": "note", "strategy": "redact"}]
    job = Job(spark, columns=KINDS | {"cust": "string"}, pii={"columns": pii}).write(raw_orders(spark, sf_dir, True))
    job.run()
    return job.accepted()


@query("SELECT o_orderkey AS \"orderKey\", o_custkey AS \"custNo\", NULL::DATE AS later FROM orders WHERE o_orderkey % 10 != 0")
def ingest_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are normalised, a source is renamed, a missing column is null, others are dropped."""
    rows = raw_orders(spark, sf_dir).withColumn("Order Key", F.col("key")).withColumn("CUST", F.col("cust"))
    job = Job(spark, columns={"order key": "integer", "custNo": "integer", "later": "date"}, schema={"normalize_columns": {"enabled": True, "strategy": "camel_case"}})
    job.entity["schema"]["columns"][1] |= {"source": "CUST", "nullable": False}
    rows.select("Order Key", "CUST", "status").write.options(sep=";", header=True, emptyValue="").csv(f"{job.top}/in")
    job.run()
    return job.accepted()


@query("SELECT o_orderstatus AS status, count(*) AS rows FROM orders WHERE o_orderkey % 10 != 0 AND o_orderkey % 7 != 0 GROUP BY o_orderstatus")
def ingest_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a status; its rows are counted by folder."""
    job = Job(spark, accepted={"partition_by": ["status"]}).write(raw_orders(spark, sf_dir))
    job.run()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{job.top}/accepted")
    return rows.groupBy(F.regexp_extract("_metadata.file_path", "status=([^/]*)/", 1).alias("status")).agg(F.count("*").alias("rows"))
