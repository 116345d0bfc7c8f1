"""Row checks as expressions: an array of (rule, column, message) for each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS, ROW_INDEX = "__dq_errors", "__dq_row_index"
FILE_ORD, FILE, ROW = "__file_ord", "__file", "__row_index"
RAW = "raw_"
ERROR_TYPE = "array<struct<rule:string,column:string,message:string>>"
#: Messages that reports and rejected rows carry.
MISSING, INVALID, DUPLICATE, DUPLICATE_KEY = "required value missing", "invalid value for target type", "duplicate value", "duplicate key"


def error(rule: str, column: str, message: str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.lit(message).alias("message"))


def not_null_error(column: str) -> Column:
    return F.when(F.col(f"`{column}`").isNull(), error("not_null", column, MISSING))


def cast_error(raw: str, column: str) -> Column:
    """The raw cell has something and the typed one nothing."""
    return F.when(F.col(f"`{raw}`").isNotNull() & F.col(f"`{column}`").isNull(), error("cast_error", column, INVALID))


def gathered(found: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*found)).cast(ERROR_TYPE) if found else F.array().cast(ERROR_TYPE)


def row_errors(required: Sequence[str], casts: Sequence[tuple[str, str]], duplicates: Sequence[tuple[str, str]] = ()) -> Column:
    """All of a row's errors: not_null, then casts, then duplicates (flag column, key name), each in
    declared order. casts: (raw, typed) columns."""
    found = [not_null_error(c) for c in required] + [cast_error(r, c) for r, c in casts]
    found += [F.when(F.col(flag), error("unique", name, DUPLICATE_KEY if name.startswith("[") else DUPLICATE)) for flag, name in duplicates]
    return gathered(found)


def split(df: DataFrame, errors: str = ERRORS) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    return df.where(F.size(errors) == 0), df.where(F.size(errors) > 0)


# --- formats of a rejected row's errors -----------------------------------------------------------
def _quoted(text: Column) -> Column:
    """A JSON string."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def format_errors(errors: Column, kind: str = "json", sources: dict[str, str] | None = None) -> Column:
    """json: an array of objects; csv: lines `rule,column,message`; text: `rule:column message` joined
    by `; `. The last two are JSON strings. sources: selectors of columns, put after the column's name.
    Null where there are no errors."""
    names = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair]) if sources else None

    def source(e: Column) -> Column | None:
        return F.try_element_at(names, e["column"]) if names is not None else None

    if kind == "json":
        fields = lambda e: [e["rule"].alias("rule"), e["column"].alias("column"), *([source(e).alias("source")] if names is not None else []), e["message"].alias("message")]
        out = F.to_json(F.transform(errors, lambda e: F.struct(*fields(e))))
    elif kind == "csv":
        out = _quoted(F.array_join(F.transform(errors, lambda e: F.concat_ws(",", e["rule"], e["column"], *([F.coalesce(source(e), F.lit(""))] if names is not None else []), e["message"])), "\n"))
    elif kind == "text":
        label = lambda e: F.concat(e["column"], F.when(source(e).isNotNull(), F.concat(F.lit(" ("), source(e), F.lit(")"))).otherwise("")) if names is not None else e["column"]
        out = _quoted(F.array_join(F.transform(errors, lambda e: F.concat(e["rule"], F.lit(":"), label(e), F.lit(" "), e["message"])), "; "))
    else:
        raise ValueError(f"unsupported error format: {kind}")
    return F.when(F.size(errors) > 0, out)
