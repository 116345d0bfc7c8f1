"""What the operators share: tables in the folder that all executors see, and hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Rows of the Arrow batches that go between the JVM and Python, unless the session sets its own number.
#: Spark's default is for narrow rows; ten thousand texts take tens of megabytes at both ends of each task.
BATCH, DEFAULT_BATCH = "1000", "10000"
#: The class `[\x20\x09-\x0D]` of the contracts; bytes.split() and bytes.strip() use just these.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def importable(spark: SparkSession) -> SparkSession:
    """A session whose workers can import this package and get texts in small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH:
        spark.conf.set(name, BATCH)
    return session.importable(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode, where all threads share it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegate-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Scratch:
    """Tables written to the shared folder. They cut lineage as checkpoint() does, but are compressed
    and can be read by column. keep() writes one; drop() removes one that no later plan reads; the
    rest go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = importable(spark), f"{shared_folder(spark)}/tidegate-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._tidegate_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (path := getattr(df, "_tidegate_path", None)):
            _delete(self.spark, path)

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(self.spark, self.root)


#: Rows of ids that are broadcast, at most: under 10 MB.
BROADCAST_IDS = 500_000


def broadcast_if_few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if its counted rows are few; else the join shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (the finalizer of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def sliced(parts: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches of the same rows, uncopied: what a worker makes of a batch is held at once."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """Texts of a batch; null reads as the empty text."""
    return [t or "" for t in column.to_pylist()]


def batches(rows: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := rows[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def lower_ascii(column):
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)
