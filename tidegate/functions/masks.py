"""Masking of personal data, as expressions. Null stays null."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("hash", "drop", "nullify", "redact", "mask", "tokenize")
_TOKEN = re.compile(r"\{(first|last)(\d+)\}")


def hashed(column: Column) -> Column:
    return F.sha2(column, 256)


def redacted(column: Column, value: str = "[REDACTED]") -> Column:
    return F.when(column.isNotNull(), F.lit(value))


def mask_value(column: Column, pattern: str) -> Column:
    """`{firstN}` and `{lastN}` stand for code points of the value. Of a short value the last ones go
    first, and the first ones get what is left, so no character shows twice."""
    length = F.char_length(column)
    last = max((int(n) for kind, n in _TOKEN.findall(pattern) if kind == "last"), default=0)
    parts, at = [], 0
    for m in _TOKEN.finditer(pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        n = int(m[2])
        if m[1] == "last":
            parts.append(F.when(F.lit(n) > 0, F.right(column, F.least(F.lit(n), length))).otherwise(""))
        else:
            parts.append(F.left(column, F.greatest(F.lit(0), F.least(F.lit(n), length - F.least(F.lit(last), length)))))
        at = m.end()
    parts.append(F.lit(pattern[at:]))
    return F.when(column.isNotNull(), F.concat(*parts))


def mask(df: DataFrame, rules: dict[str, tuple[str, str | None]]) -> DataFrame:
    """rules: column -> (strategy, pattern or replacement). Absent columns are passed over."""
    for name, (strategy, value) in rules.items():
        if name not in df.columns:
            continue
        column = F.col(f"`{name}`")
        match strategy:
            case "hash":
                df = df.withColumn(name, hashed(column))
            case "drop":
                df = df.drop(name)
            case "nullify":
                df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
            case "redact":
                df = df.withColumn(name, redacted(column, value or "[REDACTED]"))
            case "mask":
                df = df.withColumn(name, mask_value(column, value or ""))
            case _:
                raise ValueError(f"unsupported masking strategy: {strategy}")
    return df
