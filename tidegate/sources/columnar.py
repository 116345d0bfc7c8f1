"""Parquet and ORC: typed cells, of declared columns only."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Files
from .lines import AT, SPLIT, literal, running, with_file


def columns_of(files: Files, path: str, kind: str) -> list[str]:
    """From the footer alone. ValueError if it can't be read."""
    apache, (_, p) = files.jvm.org.apache, files.hadoop(path)
    try:
        if kind == "orc":
            found = apache.orc.OrcFile.createReader(p, apache.orc.OrcFile.readerOptions(files.conf))
            try:
                return list(found.getSchema().getFieldNames())
            finally:
                found.close()
        opened = apache.parquet.hadoop.ParquetFileReader.open(apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, files.conf))
        try:
            return [f.getName() for f in opened.getFileMetaData().getSchema().getFields()]
        finally:
            opened.close()
    except Py4JJavaError as x:
        raise ValueError(f"{kind}_read_error: {x.java_exception.getMessage()}") from None


def read_columnar(spark: SparkSession, files: Sequence[tuple[int, str]], kind: str, columns: Sequence[str]) -> DataFrame:
    """Typed cells as cell_<column>, and the rows' places."""
    scan = spark.read.format(kind).load(literal(p for _, p in files))
    cells = [F.col(f"`{c}`").alias(f"cell_{c}") for c in columns if c in scan.columns]
    if kind == "parquet":
        return with_file(scan, files, [*cells, F.col("_metadata.row_index").alias(AT)]).withColumn(SPLIT, F.lit(0).cast("long"))
    return with_file(scan, files, [*cells, running()], split=True)
