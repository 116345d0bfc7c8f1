"""Sinks: Parquet folders, versioned tables, DuckDB, tables of a connector, and the rejected rows' CSV."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import merge
from ..session import importable, workspace
from ..storage import Files, joined

SMALL_FILE, LARGE_FILE = 16 << 20, 256 << 20
#: Rows whose width is measured to size files.
MEASURED = 1000


@dataclass
class Merge:
    """What a merge does, in output names. compare and now are history's."""

    key: list[str]
    ignore: list[str] = field(default_factory=list)
    compare: list[str] = field(default_factory=list)
    now: Column | None = None
    names: merge.HistoryNames = merge.HistoryNames()


class Table(Protocol):
    """A table that is appended to and merged into. read() is None where there is none."""

    def read(self) -> DataFrame | None: ...
    def keys(self, columns: Sequence[str]) -> DataFrame | None: ...
    def overwrite(self, df: DataFrame) -> None: ...
    def append(self, df: DataFrame) -> None: ...
    def upsert(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]: ...
    def record(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]: ...


# --- Parquet --------------------------------------------------------------------------------------
def row_bytes(df: DataFrame) -> float:
    """The mean width of some rows' cells as text: an upper bound for what they take in a file."""
    cells = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema]
    found = df.limit(MEASURED).select(sum(cells[1:], cells[0]).alias("n")).agg(F.avg("n")).first()[0]
    return max(1.0, found or 1.0)


def write_parquet(df: DataFrame, path: str, mode: str, options=None, partition_by: Sequence[str] = (), rows: int = 0) -> int:
    """The number of rows written. overwrite clears the folder's own parts only: a folder with other
    files is refused. Files stay under options.max_size_per_file (256 MiB); rows: how many there are, as
    far as known."""
    if mode == "overwrite":
        foreign = [n for n in Files(df.sparkSession).names(path) if not n.startswith(("part-", "_", ".")) and "=" not in n]
        if foreign:
            raise ValueError(f"{path} holds other files: {foreign[:3]}")
    limit = options.max_size_per_file if options and options.max_size_per_file else LARGE_FILE
    large = df.columns and (limit < LARGE_FILE or rows * len(df.columns) > limit // 32)  # else no file can be
    width = row_bytes(df) if large else 0
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("n")).write.mode(mode)
    if options and options.compression:
        writer = writer.option("compression", "none" if options.compression == "uncompressed" else options.compression)
    if options and options.row_group_size:
        writer = writer.option("parquet.block.size", options.row_group_size)
    if large:
        writer = writer.option("maxRecordsPerFile", max(1, int(limit / width)))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return written.get["n"]


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    names = Files(spark).names(path)
    return spark.read.parquet(path) if any(n.startswith("part-") or "=" in n for n in names) else None


# --- versions -------------------------------------------------------------------------------------
class VersionedTable:
    """Each commit writes a folder of its own and then moves a pointer that lists the folders of the
    table, so a reader sees a whole version and a plan may read the table that it replaces. An append
    adds a folder; only merges rewrite. Folders that the last versions don't list are deleted."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.root, self.kept = spark, path.rstrip("/"), keep
        self.files = Files(spark)

    def _pointer(self) -> dict[str, Any]:
        at = joined(self.root, "_current")
        return json.loads(self.files.read(at)) if self.files.exists(at) else {"version": 0, "folders": [], "before": []}

    def version(self) -> int:
        return self._pointer()["version"]

    def read(self) -> DataFrame | None:
        now = self._pointer()
        if not now["version"]:
            return None
        return self.spark.read.schema(StructType.fromJson(now["schema"])).parquet(*[joined(self.root, f) for f in now["folders"]])

    def keys(self, columns: Sequence[str]) -> DataFrame | None:
        old = self.read()
        return None if old is None else old.select(*[f"`{c}`" for c in columns])

    def _commit(self, df: DataFrame, schema: StructType, add: bool) -> None:
        now = self._pointer()
        v = now["version"] + 1
        df.write.mode("overwrite").parquet(joined(self.root, f"v{v}"))
        folders = [*(now["folders"] if add else []), f"v{v}"]
        before = [now["folders"], *now["before"]][: self.kept - 1]
        self.files.write(joined(self.root, "_current"), json.dumps({"version": v, "folders": folders, "before": before, "schema": json.loads(schema.json())}))
        needed = {f for own in [folders, *before] for f in own}
        for f in {f for own in now["before"] for f in own} - needed:
            self.files.delete(joined(self.root, f))

    def overwrite(self, df: DataFrame) -> None:
        self._commit(df, df.schema, False)

    def append(self, df: DataFrame) -> None:
        old = self.read()
        names = {f.name for f in df.schema}
        schema = df.schema if old is None else StructType([*[f for f in old.schema if f.name in names], *[f for f in df.schema if f.name not in old.columns]])
        self._commit(df.select(*[f"`{c}`" for c in schema.names]), schema, True)

    def upsert(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]:
        out = merge.scd1_metrics(old, df, m.key).first().asDict()
        self.overwrite(merge.scd1(old, df, m.key, m.ignore))
        return out

    def record(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]:
        out = merge.scd2_metrics(old, df, m.key, m.compare, m.names).first().asDict()
        self.overwrite(merge.scd2(old, df, m.key, m.compare, m.now, m.names))
        return out


# --- DuckDB ---------------------------------------------------------------------------------------
def arrow_batches(df: DataFrame) -> Iterator[pa.Table]:
    """The rows as Arrow tables, a partition at a time: the driver never holds them all."""
    importable(df.sparkSession)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema) as stream:
                stream.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    for row in df.mapInArrow(packed, "ipc binary").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.open_stream(row[0]).read_all()


class DuckDbTable:
    """A table in a DuckDB file on the driver. Rows come over in Arrow batches; appends insert, merges
    update and insert from a temporary table, each in one transaction."""

    def __init__(self, spark: SparkSession, path: str, table: str, schema: str | None = None):
        import duckdb

        self.spark, self.path, self.duckdb = spark, path, duckdb
        self.name = ".".join(f'"{x}"' for x in ([schema] if schema else []) + [table])
        self.schema = schema
        self.spooled: list[str] = []

    def _exists(self, con) -> bool:
        try:
            con.sql(f"SELECT 1 FROM {self.name} LIMIT 0")
            return True
        except self.duckdb.CatalogException:
            return False

    def read(self) -> DataFrame | None:
        """The table's shape, without rows: no merge reads it into Spark."""
        with self.duckdb.connect(self.path) as con:
            return self.spark.createDataFrame(con.sql(f"SELECT * FROM {self.name} LIMIT 0").to_arrow_table()) if self._exists(con) else None

    def keys(self, columns: Sequence[str]) -> DataFrame | None:
        """The columns of all rows, as a Parquet file in the shared folder: neither the driver's memory nor
        a plan holds them. It stays until release() or the driver's end."""
        chosen = f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM {self.name}"
        with tempfile.TemporaryDirectory(prefix="tidegate-") as own, self.duckdb.connect(self.path) as con:
            if not self._exists(con):
                return None
            shape = self.spark.createDataFrame(con.sql(f"{chosen} LIMIT 0").to_arrow_table()).schema
            con.execute("SET threads = 1; SET memory_limit = '256MB'")  # a scan needs no more; else DuckDB keeps what it read
            at = f"{os.path.realpath(own)}/keys.parquet"  # the JVM may see other links
            con.execute(f"COPY ({chosen}) TO '{at.replace("'", "''")}' (FORMAT parquet)")
            path = workspace(self.spark)
            self.spooled.append(path)
            atexit.register(self.release)
            Files(self.spark).copy(at, joined(path, "part-0.parquet"))
        return self.spark.read.parquet(path).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in shape])

    def release(self) -> None:
        """Deletes what keys() wrote."""
        while self.spooled:
            with contextlib.suppress(Exception):  # the session may have ended before
                Files(self.spark).delete(self.spooled.pop())

    def _stage(self, con, df: DataFrame, name: str, create: str) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        if self.schema:
            con.execute(f'CREATE SCHEMA IF NOT EXISTS "{self.schema}"')
        batch = to_arrow_schema(df.schema).empty_table()  # noqa: F841  read by the next statement
        con.execute(f"{create} {name} AS FROM batch")
        for batch in arrow_batches(df):  # noqa: B007
            con.execute(f"INSERT INTO {name} BY NAME FROM batch")

    def _in_transaction(self, work) -> Any:
        with self.duckdb.connect(self.path) as con:
            con.begin()
            out = work(con)
            con.commit()
            return out

    def overwrite(self, df: DataFrame) -> None:
        self._in_transaction(lambda con: self._stage(con, df, self.name, "CREATE OR REPLACE TABLE"))

    def append(self, df: DataFrame) -> None:
        self._in_transaction(lambda con: self._stage(con, df, self.name, "CREATE TABLE IF NOT EXISTS"))

    @staticmethod
    def _on(key: Sequence[str]) -> str:
        return " AND ".join(f't."{c}" = s."{c}"' for c in key)

    def _count(self, con, what: str) -> int:
        return con.execute(f"SELECT count(*) FROM {what}").fetchone()[0]

    def upsert(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]:
        def work(con) -> dict[str, Any]:
            self._stage(con, df, "__source", "CREATE TEMP TABLE")
            before = self._count(con, self.name)
            met = self._count(con, f"{self.name} t JOIN __source s ON {self._on(m.key)}")
            taken = [c for c in df.columns if c not in m.key and c not in m.ignore]
            if taken:
                con.execute(f"UPDATE {self.name} t SET {', '.join(f'"{c}" = s."{c}"' for c in taken)} FROM __source s WHERE {self._on(m.key)}")
            con.execute(f"INSERT INTO {self.name} BY NAME SELECT * FROM __source s WHERE NOT EXISTS (FROM {self.name} t WHERE {self._on(m.key)})")
            after = self._count(con, self.name)
            return {"inserted": after - before, "updated": met, "rows_before": before, "rows_after": after}

        return self._in_transaction(work)

    def record(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]:
        def work(con) -> dict[str, Any]:
            self._stage(con, df, "__source", "CREATE TEMP TABLE")
            before, came = self._count(con, self.name), self._count(con, "__source")
            differs = " OR ".join(f't."{c}" IS DISTINCT FROM s."{c}"' for c in m.compare) or "false"
            current = f't."{m.names.is_current}" AND {self._on(m.key)}'
            now = con.execute("SELECT localtimestamp::TIMESTAMP").fetchone()[0] if m.now is None else self.spark.range(1).select(m.now.alias("now")).first()[0]
            con.execute(f"CREATE TEMP TABLE __same AS SELECT s.* FROM __source s WHERE EXISTS (FROM {self.name} t WHERE {current} AND NOT ({differs}))")
            closed = self._count(con, f"{self.name} t JOIN __source s ON {current} AND ({differs})")
            con.execute(f'UPDATE {self.name} t SET "{m.names.is_current}" = false, "{m.names.valid_to}" = ? FROM __source s WHERE {current} AND ({differs})', [now])
            fresh = f"SELECT s.* FROM __source s WHERE NOT EXISTS (FROM __same t WHERE {self._on(m.key)})"
            con.execute(f'INSERT INTO {self.name} BY NAME SELECT *, true AS "{m.names.is_current}", ?::TIMESTAMP AS "{m.names.valid_from}", NULL::TIMESTAMP AS "{m.names.valid_to}" FROM ({fresh})', [now])
            after = self._count(con, self.name)
            return {"inserted": after - before, "closed": closed, "unchanged": came - (after - before), "rows_before": before, "rows_after": after}

        return self._in_transaction(work)


# --- connectors -----------------------------------------------------------------------------------
class ConnectorTable:
    """A Delta or Iceberg table by its connector: appends append, merges are MERGE statements. It lies at
    path or, with a name, in a catalog."""

    def __init__(self, spark: SparkSession, path: str, kind: str, name: str | None = None):
        self.spark, self.path, self.kind, self.name = spark, path, kind, name
        try:
            spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(kind, spark._jsparkSession.sessionState().conf())
        except Py4JJavaError:
            raise RuntimeError(f"the {kind} connector is not on the classpath") from None

    def read(self) -> DataFrame | None:
        try:
            return self.spark.table(self.name) if self.name else self.spark.read.format(self.kind).load(self.path)
        except PySparkException as x:
            if any(s in str(x) for s in ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "DELTA_TABLE_NOT_FOUND", "is not a Delta table", "DELTA_MISSING", "Cannot find table")):
                return None
            raise

    def keys(self, columns: Sequence[str]) -> DataFrame | None:
        old = self.read()
        return None if old is None else old.select(*[f"`{c}`" for c in columns])

    def overwrite(self, df: DataFrame) -> None:
        if self.name:
            df.writeTo(self.name).using(self.kind).createOrReplace()
        else:
            df.write.format(self.kind).mode("overwrite").save(self.path)

    def append(self, df: DataFrame) -> None:
        if self.name and self.read() is None:
            df.writeTo(self.name).using(self.kind).create()
        elif self.name:
            df.writeTo(self.name).append()
        else:
            df.write.format(self.kind).mode("append").save(self.path)

    @property
    def _target(self) -> str:
        return self.name or f"{self.kind}.`{self.path}`"

    def _merge(self, source: DataFrame, statement: str) -> None:
        source.createOrReplaceTempView("__tidegate_source")
        try:
            self.spark.sql(statement)
        finally:
            self.spark.catalog.dropTempView("__tidegate_source")

    def upsert(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]:
        out = merge.scd1_metrics(old, df, m.key).first().asDict()
        self._merge(df, merge.scd1_statement(self._target, "__tidegate_source", df.columns, m.key, m.ignore))
        return out

    def record(self, old: DataFrame, df: DataFrame, m: Merge) -> dict[str, Any]:
        out = merge.scd2_metrics(old, df, m.key, m.compare, m.names).first().asDict()
        staged = merge.scd2_staged(old, df, m.key, m.compare, m.now, m.names)
        self._merge(staged, merge.scd2_statement(self._target, "__tidegate_source", df.columns, m.key, m.names))
        return out


def write_rejected(df: DataFrame, path: str, mode: str) -> int:
    """Rejected rows as CSV with a header; how many they are."""
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.mode(mode).option("header", True).option("nullValue", "").option("escape", '"').csv(path)
    return written.get["n"]


@dataclass
class SizeMetrics:
    files: int
    bytes: int
    average_mb: float | None
    small_files: int


def size_metrics(spark: SparkSession, path: str, target: int | None = None) -> SizeMetrics:
    """Of the part files, those below partitions too: small ones are under half the target size, or under
    16 MiB."""
    parts = Files(spark).parts(path)
    total = sum(n for _, n in parts)
    limit = target / 2 if target else SMALL_FILE
    return SizeMetrics(len(parts), total, total / len(parts) / (1 << 20) if parts else None, sum(n < limit for _, n in parts))
