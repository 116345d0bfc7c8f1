"""Fixed-width text: cells are slices by characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import AT, FILE_ORD, SPLIT, read_lines


def slices(line: Column, fields: Sequence[tuple[str, int, bool]]) -> list[Column]:
    """fields: (name, width, trim). An empty cell is null."""
    line, out, at = F.rtrim(line, F.lit("\r")), [], 1
    for name, width, trim in fields:
        cell = F.substring(line, at, width)
        out.append(F.nullif(F.trim(cell) if trim else cell, F.lit("")).alias(name))
        at += width
    return out


def misfit(line: Column, width: int) -> Column:
    """A line that is too short, or has more than blanks after its cells."""
    line = F.rtrim(line, F.lit("\r"))
    return (F.char_length(line) < width) | (F.trim(F.substring(line, width + 1, 1 << 20)) != "")


def read_fixed(spark: SparkSession, files: Sequence[tuple[int, str]], fields: Sequence[tuple[str, int, bool]]) -> DataFrame:
    """Raw columns, the rows' places, and __bad where the line doesn't fit, which rejects its file."""
    lines = read_lines(spark, files)
    bad = misfit(F.col("value"), sum(w for _, w, _ in fields))
    return lines.select(*slices(F.col("value"), [(f"raw_{n}", w, t) for n, w, t in fields]), FILE_ORD, SPLIT, AT, bad.alias("__bad"))
