"""Merges: upsert (scd1) and history (scd2), each one pass of joins over the target.

A null key never matches. The source has no duplicate keys: the primary key's uniqueness has forced
them out before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HistoryNames:
    is_current: str = "__dq_is_current"
    valid_from: str = "__dq_valid_from"
    valid_to: str = "__dq_valid_to"


class SchemaConflict(ValueError):
    pass


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{tag}_{c}") for c in df.columns], F.lit(True).alias(f"{tag}__there"))


def _same(key: Sequence[str]) -> list[Column]:
    return [F.col(f"`t_{c}`") == F.col(f"`s_{c}`") for c in key]


def changed(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"`t_{c}`").eqNullSafe(F.col(f"`s_{c}`"))
    return out


def scd1(target: DataFrame, source: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Matched rows take the source's columns but for the key and ignored ones; new rows come whole."""
    met = _tagged(target, "t").join(_tagged(source, "s"), _same(key), "full_outer")
    here, new = F.col("t__there").isNotNull(), F.col("s__there").isNotNull()
    pick = lambda c: F.when(here & (~new | F.lit(c in ignore)), F.col(f"`t_{c}`")).otherwise(F.col(f"`s_{c}`")).alias(c)
    return met.select(*[pick(c) if c in source.columns else F.col(f"`t_{c}`").alias(c) for c in target.columns])


def scd1_metrics(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: inserted, updated, rows_before, rows_after."""
    t, s = _tagged(target.select(*key), "t"), _tagged(source.select(*key), "s")
    met = t.join(s, _same(key), "full_outer")
    count = lambda c: F.count_if(c).cast("long")
    here, new = F.col("t__there").isNotNull(), F.col("s__there").isNotNull()
    return met.agg(count(new & ~here).alias("inserted"), count(new & here).alias("updated"), count(here).alias("rows_before"), F.count("*").alias("rows_after"))


def compare_columns(source: DataFrame, key: Sequence[str], compare: Sequence[str] = (), ignore: Sequence[str] = ()) -> list[str]:
    return [c for c in (compare or source.columns) if c not in key and c not in ignore]


def history(first: DataFrame, now: Column, names: HistoryNames = HistoryNames()) -> DataFrame:
    """A first load."""
    return first.select("*", F.lit(True).alias(names.is_current), now.alias(names.valid_from), F.lit(None).cast("timestamp_ntz").alias(names.valid_to))


def scd2(target: DataFrame, source: DataFrame, key: Sequence[str], compare: Sequence[str], now: Column, names: HistoryNames = HistoryNames()) -> DataFrame:
    """Current rows that the source changes are closed; changed and new source rows come in as current.

    One outer join of the current rows gives both: a changed match becomes two rows.
    """
    past, current = target.where(~F.col(names.is_current)), target.where(F.col(names.is_current))
    met = _tagged(current, "t").join(_tagged(source, "s"), _same(key), "full_outer")
    here, new = F.col("t__there").isNotNull(), F.col("s__there").isNotNull()
    differs = here & new & changed(compare)
    system = (names.is_current, names.valid_from, names.valid_to)
    data = [c for c in target.columns if c not in system]
    old = F.struct(*[F.col(f"`t_{c}`").alias(c) for c in data], F.when(differs, False).otherwise(F.col(f"t_{system[0]}")).alias(system[0]), F.col(f"t_{system[1]}").alias(system[1]), F.when(differs, now).otherwise(F.col(f"t_{system[2]}")).alias(system[2]))
    added = F.struct(*[(F.col(f"`s_{c}`") if c in source.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in data], F.lit(True).alias(system[0]), now.alias(system[1]), F.lit(None).cast("timestamp_ntz").alias(system[2]))
    rows = met.select(F.explode(F.array_compact(F.array(F.when(here, old), F.when(new & (~here | differs), added)))).alias("r")).select("r.*")
    return past.unionByName(rows.select(*[f"`{c}`" for c in target.columns]))


def scd2_metrics(target: DataFrame, source: DataFrame, key: Sequence[str], compare: Sequence[str], names: HistoryNames = HistoryNames()) -> DataFrame:
    """One row: inserted, closed, unchanged, rows_before, rows_after."""
    current = target.where(F.col(names.is_current)).select(*key, *compare)
    met = _tagged(current, "t").join(_tagged(source.select(*key, *compare), "s"), _same(key), "full_outer")
    here, new = F.col("t__there").isNotNull(), F.col("s__there").isNotNull()
    counts = met.agg(F.count_if(new & (~here | changed(compare))).alias("inserted"), F.count_if(here & new & changed(compare)).alias("closed"), F.count_if(new).alias("n"))
    before = target.agg(F.count("*").alias("rows_before"))
    both = counts.unionByName(before, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("inserted", "closed", "n", "rows_before")])  # a row each
    return both.select("inserted", "closed", (F.col("n") - F.col("inserted")).alias("unchanged"), "rows_before", (F.col("rows_before") + F.col("inserted")).alias("rows_after"))


def evolve(target: DataFrame, source: DataFrame, mode: str = "strict", key: Sequence[str] = (), system: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """target with the source's new columns, null, and their names. Only additions are possible, and
    only where mode is add_columns; never a key."""
    have, come = {f.name: f.dataType for f in target.schema if f.name not in system}, {f.name: f.dataType for f in source.schema}
    if gone := sorted(have.keys() - come.keys()):
        raise SchemaConflict(f"columns missing from the source: {gone}")
    if other := sorted(c for c in have if have[c] != come[c]):
        raise SchemaConflict(f"columns with another type: {other}")
    added = [c for c in come if c not in have]
    if added and mode != "add_columns":
        raise SchemaConflict(f"columns not in the target: {added}")
    if bad := [c for c in added if c in key]:
        raise SchemaConflict(f"key columns can't be added: {bad}")
    return target.select("*", *[F.lit(None).cast(come[c]).alias(c) for c in added]), added


def append(target: DataFrame, source: DataFrame, mode: str = "strict") -> DataFrame:
    return evolve(target, source, mode)[0].unionByName(source)


# --- the same as MERGE statements, for tables whose connector has them ------------------------------
def _on(key: Sequence[str]) -> str:
    return " AND ".join(f"t.`{c}` = s.`{c}`" for c in key)


def scd1_statement(target: str, source: str, columns: Sequence[str], key: Sequence[str], ignore: Sequence[str] = ()) -> str:
    taken = ", ".join(f"t.`{c}` = s.`{c}`" for c in columns if c not in key and c not in ignore)
    matched = f"WHEN MATCHED THEN UPDATE SET {taken} " if taken else ""
    return f"MERGE INTO {target} t USING {source} s ON {_on(key)} {matched}WHEN NOT MATCHED THEN INSERT ({', '.join(f'`{c}`' for c in columns)}) VALUES ({', '.join(f's.`{c}`' for c in columns)})"


def scd2_staged(target: DataFrame, source: DataFrame, key: Sequence[str], compare: Sequence[str], now: Column, names: HistoryNames = HistoryNames()) -> DataFrame:
    """The source's new and changed rows, with __close: the changed ones come twice, once to close the row
    that is current and once to be inserted."""
    current = _tagged(target.where(F.col(names.is_current)).select(*[f"`{c}`" for c in dict.fromkeys([*key, *compare])]), "t")
    met = _tagged(source, "s").join(current, _same(key), "left")
    here = F.col("t__there").isNotNull()
    rows = met.where(~here | changed(compare)).select(*[F.col(f"`s_{c}`").alias(c) for c in source.columns], F.explode(F.when(here, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("__close"))
    return rows.withColumn("__now", now)


def scd2_statement(target: str, source: str, columns: Sequence[str], key: Sequence[str], names: HistoryNames = HistoryNames()) -> str:
    system = [names.is_current, names.valid_from, names.valid_to]
    into = ", ".join(f"`{c}`" for c in [*columns, *system])
    values = ", ".join([*[f"s.`{c}`" for c in columns], "true", "s.__now", "NULL"])
    return f"MERGE INTO {target} t USING {source} s ON {_on(key)} AND t.`{system[0]}` AND s.__close WHEN MATCHED THEN UPDATE SET t.`{system[0]}` = false, t.`{system[2]}` = s.__now WHEN NOT MATCHED AND NOT s.__close THEN INSERT ({into}) VALUES ({values})"
