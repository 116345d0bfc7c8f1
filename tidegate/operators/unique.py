"""Uniqueness: the first row of a key stands, later ones are duplicates.

Order is (file, row). A key with a null part isn't checked. Each constraint sees all rows, also those
that other checks reject, so a rejected first row still claims its key. Keys of an existing target make
all their rows duplicates.

A constraint is one shuffle: its firsts are a grouped minimum with map-side combining over narrow rows,
joined back. No window holds a key's rows in one task, so a key that a third of all rows have is
pre-aggregated, and AQE splits the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import FILE_ORD, ROW

#: Repeated keys that are broadcast, at most.
BROADCAST_KEYS = 50_000


def constraints(unique_keys: Sequence[Sequence[str]], unique_columns: Sequence[str], primary_key: Sequence[str]) -> list[tuple[str, ...]]:
    """unique_keys if there are any, else each unique column; then the primary key; each once."""
    found = [tuple(k) for k in unique_keys] or [(c,) for c in unique_columns]
    return list(dict.fromkeys([*found, *([tuple(primary_key)] if primary_key else [])]))


def key_name(key: Sequence[str]) -> str:
    return key[0] if len(key) == 1 else f"[{','.join(key)}]"


def _whole(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def _place(order: Sequence[str]) -> Column:
    """One value that orders the rows; a long where possible, which hash aggregation can take the least
    of (2^23 files of 2^40 rows)."""
    if len(order) == 1:
        return F.col(order[0])
    if list(order) == [FILE_ORD, ROW]:
        return F.shiftleft(F.col(FILE_ORD).cast("long"), 40) + F.col(ROW)
    return F.struct(*[F.col(c) for c in order])


def _keyed(key: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"__key_{i}") for i, c in enumerate(key)]


def repeated(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The keys that several rows have, and the place of the first of them."""
    keys = df.where(_whole(key)).groupBy(*_keyed(key)).agg(F.min(_place(order)).alias("__first"), F.count("*").alias("__n"))
    return keys.where("__n > 1").drop("__n")


def with_duplicates(df: DataFrame, key: Sequence[str], order: Sequence[str], flag: str, seed: DataFrame | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """df with a boolean `flag`. order: columns that put the rows in a total order. seed: the target's
    rows with the key's columns; its keys are taken before any row. firsts: what repeated() gave, if the
    caller has it already."""
    firsts = repeated(df, key, order) if firsts is None else firsts
    out = df.join(firsts, [F.col(f"`{c}`") == F.col(f"__key_{i}") for i, c in enumerate(key)], "left")
    late = F.coalesce(_place(order) != F.col("__first"), F.lit(False))
    if seed is not None:
        taken = seed.where(_whole(key)).select(*[F.col(f"`{c}`").alias(f"__taken_{i}") for i, c in enumerate(key)]).distinct().withColumn("__taken", F.lit(True))
        out = out.join(taken, [F.col(f"`{c}`") == F.col(f"__taken_{i}") for i, c in enumerate(key)], "left")
        late = late | F.col("__taken").isNotNull()
    return out.withColumn(flag, late & _whole(key)).select(*[f"`{c}`" for c in df.columns], flag)


def with_duplicates_counted(df: DataFrame, key: Sequence[str], order: Sequence[str], flag: str, seed: DataFrame | None = None) -> tuple[DataFrame, bool, DataFrame | None]:
    """The same after counting the repeated keys: none need no join, few (BROADCAST_KEYS) are broadcast,
    so that clean data are shuffled by key and place alone and not as whole rows. Also whether the
    result is cheap to compute again, and the persisted keys, which the caller releases."""
    firsts = repeated(df, key, order).persist()
    n = firsts.count()
    if not n and seed is None:
        firsts.unpersist()
        return df.withColumn(flag, F.lit(False)), True, None
    few = n <= BROADCAST_KEYS
    return with_duplicates(df, key, order, flag, seed, F.broadcast(firsts) if few else firsts), few and seed is None, firsts


def taken_count(df: DataFrame, key: Sequence[str], flag: str, seed: DataFrame) -> int:
    """How many of the duplicates have a key that the target has."""
    taken = seed.where(_whole(key)).select(*_keyed(key)).distinct()
    return df.where(flag).join(taken, [F.col(f"`{c}`") == F.col(f"__key_{i}") for i, c in enumerate(key)], "left_semi").count()


def unique_stats(df: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """One row: how many rows are duplicates, and how many keys have some."""
    keyed = df.where(flag).groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count("*").alias("n"))
    return keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicates"), F.count("*").alias("affected_keys"))


def unique_samples(df: DataFrame, key: Sequence[str], flag: str, limit: int = 5) -> DataFrame:
    """The keys with most duplicates, then in order of their text: a report's samples."""
    text = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in key]).alias("key")
    return df.where(flag).groupBy(text).agg(F.count("*").alias("duplicates")).orderBy(F.desc("duplicates"), "key").limit(limit)
