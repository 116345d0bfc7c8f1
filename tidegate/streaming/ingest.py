"""An extension: the same row checks over files as they arrive, with Spark's checkpoint as the ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import casts
from ..operators import checks


def ingest_available(spark: SparkSession, folder: str, columns: Sequence[tuple[str, str, bool]], checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], separator: str = ";") -> StreamingQuery:
    """Checks the CSV files that are new in folder, and ends. columns: (name, type, required), in the
    files' order. sink gets accepted and rejected rows of each micro-batch, and its number; a batch that
    is run again after a failure has the same number."""
    raw = spark.readStream.schema(", ".join(f"`raw_{n}` string" for n, _, _ in columns)).options(sep=separator, header=True).csv(folder)
    rows = raw.select(*[casts.typed(F.col(f"`raw_{n}`"), kind).alias(n) for n, kind, _ in columns], *[F.col(f"`raw_{n}`") for n, _, _ in columns])
    casts_ = [(f"raw_{n}", n) for n, kind, _ in columns if casts.canonical(kind) != "string"]
    checked = rows.withColumn(checks.ERRORS, checks.row_errors([n for n, _, need in columns if need], casts_)).drop(*[f"raw_{n}" for n, _, _ in columns])

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(*checks.split(batch), number)
        batch.unpersist()

    return checked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
