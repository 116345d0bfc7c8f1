"""Schema mismatch: the columns that a file has against those declared."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import spark_type

REPORTED = 50


@dataclass
class MismatchPlan:
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    action: str = "none"
    rejected: bool = False
    aborted: bool = False
    warnings: int = 0
    message: str | None = None


def takes_part(selector: str | None) -> bool:
    """Only top-level selectors are compared with a document's keys."""
    return not (selector and re.search(r"[.\[/@]", selector))


def plan_mismatch(declared: Sequence[str], found: Sequence[str], missing: str = "fill_nulls", extra: str = "ignore", severity: str = "warn") -> MismatchPlan:
    """What to do with a file. missing: fill_nulls or reject_file; extra: ignore or reject_file. warn
    turns a rejection into one warning; else the file is rejected or, under abort, the run ended."""
    out = MismatchPlan(sorted(set(declared) - set(found)), sorted(set(found) - set(declared)))
    fails = bool(out.missing and missing == "reject_file" or out.extra and extra == "reject_file")
    if fails and severity != "warn":
        out.rejected, out.aborted, out.action = severity == "reject", severity == "abort", "aborted" if severity == "abort" else "rejected_file"
        out.message = f"schema mismatch: missing {out.missing[:REPORTED]}, extra {out.extra[:REPORTED]}"
        return out
    out.warnings = int(fails)
    out.action = "filled_nulls" if out.missing else "ignored_extras" if out.extra else "none"
    return out


def apply_mismatch(df: DataFrame, declared: dict[str, str], raw_prefix: str | None = None) -> DataFrame:
    """df with the declared columns (name -> type) in order: missing ones null, others dropped, but for
    reserved ones. raw_prefix: missing ones also get a null text column so prefixed."""
    own = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(spark_type(kind)).alias(c) for c, kind in declared.items()]
    if raw_prefix:
        own += [F.col(f"`{raw_prefix}{c}`") if f"{raw_prefix}{c}" in df.columns else F.lit(None).cast("string").alias(raw_prefix + c) for c in declared]
    return df.select(*own, *[F.col(f"`{c}`") for c in df.columns if c.startswith("__") and c not in declared])
