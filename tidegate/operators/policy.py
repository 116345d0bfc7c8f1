"""Severities: what happens to rows and files with errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import ERRORS, FILE_ORD

SEVERITIES = ("warn", "reject", "abort")


@dataclass
class Routed:
    """accepted and rejected rows; error_rows: those whose errors are reported; stopped: the place of
    the file that ended the entity, if one did."""

    accepted: DataFrame
    rejected: DataFrame
    error_rows: DataFrame
    stopped: int | None = None


def first_bad_file(df: DataFrame) -> int | None:
    return df.where(F.size(ERRORS) > 0).agg(F.min(FILE_ORD)).first()[0]


def route(df: DataFrame, severity: str, forced: Column | None = None) -> Routed:
    """warn keeps all rows but those forced out; reject splits; abort keeps the files before the first
    one with an error, rejects that file as a whole, and drops the files after it.

    forced: rows that a merge must not see (duplicates of its key).
    """
    bad = F.size(ERRORS) > 0
    forced = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    if severity == "warn":
        return Routed(df.where(~forced), df.where(forced), df.where(bad))
    if severity == "reject":
        return Routed(df.where(~bad & ~forced), df.where(bad | forced), df.where(bad))
    if severity != "abort":
        raise ValueError(f"unsupported severity: {severity}")
    at = first_bad_file(df)
    if at is None:
        return Routed(df, df.limit(0), df.limit(0))
    return Routed(df.where(F.col(FILE_ORD) < at), df.where(F.col(FILE_ORD) == at), df.where((F.col(FILE_ORD) == at) & bad), at)


def only_casts_where_aborted(df: DataFrame) -> DataFrame:
    """Under abort a file with cast errors reports these alone."""
    casts = F.filter(ERRORS, lambda e: e["rule"] == "cast_error")
    files = df.where(F.size(casts) > 0).select(FILE_ORD).distinct().withColumn("__casts", F.lit(True))
    return df.join(files, FILE_ORD, "left").withColumn(ERRORS, F.when(F.col("__casts"), casts).otherwise(F.col(ERRORS))).drop("__casts")
