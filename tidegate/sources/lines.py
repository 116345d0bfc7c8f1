"""Rows with their place: the file's position in the sorted input list, the split of it, and the row's
running number in the split.

These three order the rows of a run. A row's number in its file is worked out (see with_row_index) only
for the few rows that are reported, so no scan is counted before it is used. A scan's rows keep their
numbers as long as one plan reads them, so a caller that reads twice stores them first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Files, plain

FILE_ORD, SPLIT, AT, ROW = "__file_ord", "__split", "__at", "__row_index"
#: Files whose places are broadcast, at most; a row takes some hundred bytes.
BROADCAST_FILES = 100_000


def literal(paths: Iterable[str]) -> list[str]:
    """Paths as a reader takes them for what they are, whatever characters are in them."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def with_file(scan: DataFrame, files: Sequence[tuple[int, str]], columns: Sequence[Column | str], split: bool = False) -> DataFrame:
    """columns of a scan of files, (position, path), with the files' positions, and SPLIT if asked for.

    ValueError if Spark passes over one of the files (it does where a name begins with _ or .); a row
    that no file can be found for ends the run.
    """
    known = Files(scan.sparkSession)
    wanted = {known.key(path): (i, path) for i, path in files}
    found = {plain(uri) for uri in scan.inputFiles()}
    if lost := [path for key, (_, path) in wanted.items() if key not in found]:
        raise ValueError(f"Spark passes over {len(lost)} files, such as {lost[0]}: names must not begin with _ or .")
    rows = [(uri, i) for key, (i, _) in wanted.items() for uri in {key, key.replace("file:/", "file:///", 1) if key.startswith("file:/") else key}]
    places = scan.sparkSession.createDataFrame(rows, "__uri string, __place long")
    out = scan.select(*columns, F.col("_metadata.file_path").alias("__path"), *([F.col("_metadata.file_block_start").alias(SPLIT)] if split else []))
    out = out.join(F.broadcast(places) if len(rows) <= 2 * BROADCAST_FILES else places, F.col("__path") == F.col("__uri"), "left")
    place = F.coalesce("__place", F.raise_error(F.concat(F.lit("a row's file is none of the inputs: "), F.col("__path"))).cast("long"))
    return out.withColumn(FILE_ORD, place).drop("__path", "__uri", "__place")


def running() -> Column:
    """Of the rows that the scan has given so far in this task."""
    return F.monotonically_increasing_id().alias(AT)


def whole_files(spark: SparkSession, kind: str, files: Sequence[tuple[int, str]], column: str) -> DataFrame:
    """A row a file: `column` and the file's position. A file must fit a task's memory (2 GB at most)."""
    scan = spark.read.format(kind)
    if kind == "text":
        scan = scan.option("wholetext", "true")
    return with_file(scan.load(literal(p for _, p in files)), files, [column])


def read_lines(spark: SparkSession, files: Sequence[tuple[int, str]], counted: Column | None = None) -> DataFrame:
    """value, and the lines' places; only of the lines that count, if a condition says which do."""
    scan = spark.read.text(literal(p for _, p in files))
    return with_file(scan if counted is None else scan.where(counted), files, ["value", running()], split=True)


def with_row_index(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """rows, which are some of all_rows, with their numbers in their files. One grouped count of all
    rows, by split; the join is with a row a split."""
    splits = all_rows.groupBy(FILE_ORD, SPLIT).agg(F.count("*").alias("__n"), F.min(AT).alias("__from"))
    before = splits.withColumn("__before", F.sum("__n").over(Window.partitionBy(FILE_ORD).orderBy(SPLIT)) - F.col("__n")).drop("__n")
    return rows.join(before, [FILE_ORD, SPLIT]).withColumn(ROW, F.col(AT) - F.col("__from") + F.col("__before")).drop("__from", "__before")
