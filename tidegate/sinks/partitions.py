"""Partition transforms, as columns named <column>_<transform>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("identity", "year", "month", "day", "hour")


def transform(column: str, kind: str) -> Column:
    """Years, months, days and hours count from 1970."""
    c = F.col(f"`{column}`")
    match kind:
        case "identity":
            return c.alias(column)
        case "year":
            out = F.year(c) - 1970
        case "month":
            out = (F.year(c) - 1970) * 12 + F.month(c) - 1
        case "day":
            out = F.unix_date(c.cast("date"))
        case "hour":
            out = F.unix_date(c.cast("date")) * 24 + F.hour(c)
        case _:
            raise ValueError(f"unsupported partition transform: {kind}")
    return out.cast("int").alias(f"{column}_{kind}")
