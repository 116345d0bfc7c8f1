"""A report's figures: one aggregate a question, over the checked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import ERRORS, FILE_ORD

#: The order in which reports name rules.
RULES = ("not_null", "cast_error", "unique", "schema_error")


def file_counts(df: DataFrame, file: str = FILE_ORD) -> DataFrame:
    """A row a file: rows, accepted, rejected."""
    bad = F.size(ERRORS) > 0
    return df.groupBy(file).agg(F.count("*").alias("rows"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))


def rule_summary(df: DataFrame, file: str = FILE_ORD) -> DataFrame:
    """A row a file, rule and column: violations."""
    each = df.where(F.size(ERRORS) > 0).select(file, F.explode(ERRORS).alias("e"))
    return each.groupBy(file, F.col("e.rule").alias("rule"), F.col("e.column").alias("column")).agg(F.count("*").alias("violations"))


def totals(df: DataFrame) -> DataFrame:
    bad = F.size(ERRORS) > 0
    return df.agg(F.count("*").alias("rows"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.coalesce(F.sum(F.size(ERRORS)), F.lit(0)).cast("long").alias("violations"))
