"""Declared types and casts that give null where a cell doesn't parse.

Text parses strictly: numbers have no blanks, suffixes or underscores, dates are ISO with two-digit
months and days, booleans are true, 1, false and 0 in any case with blanks around. `decimal` is a double.
Unsigned types are a wider signed type with a range guard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?"
#: Canonical name: (Spark type, pattern of its text, largest value of unsigned types).
_TYPES: dict[str, tuple[T.DataType, str | None, int | None]] = {
    "string": (T.StringType(), None, None),
    "boolean": (T.BooleanType(), None, None),
    "int8": (T.ByteType(), _INT, None),
    "int16": (T.ShortType(), _INT, None),
    "int32": (T.IntegerType(), _INT, None),
    "int64": (T.LongType(), _INT, None),
    "uint8": (T.ShortType(), _INT, 2**8 - 1),
    "uint16": (T.IntegerType(), _INT, 2**16 - 1),
    "uint32": (T.LongType(), _INT, 2**32 - 1),
    "uint64": (T.DecimalType(20, 0), _INT, 2**64 - 1),
    "float32": (T.FloatType(), _FLOAT, None),
    "float64": (T.DoubleType(), _FLOAT, None),
    "date": (T.DateType(), _DATE + "$", None),
    "datetime": (T.TimestampNTZType(), _DATE + f"([T ]{_TIME}(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$", None),
    "time": (T.StringType(), f"^{_TIME}$", None),
}
#: Other spellings, lower-cased and without - and _.
_SPELLINGS = {"str": "string", "text": "string", "bool": "boolean", "int": "int64", "integer": "int64", "long": "int64", "float": "float64", "double": "float64", "number": "float64", "decimal": "float64", "timestamp": "datetime"}


def canonical(name: str) -> str:
    """The canonical name of a declared type; ValueError if there is none."""
    key = name.strip().lower().replace("-", "").replace("_", "")
    key = _SPELLINGS.get(key, key)
    if key not in _TYPES:
        raise ValueError(f"unsupported column type: {name}")
    return key


def spark_type(name: str) -> T.DataType:
    """Times stay text that is checked: Spark's own time type is behind a flag."""
    return _TYPES[canonical(name)][0]


def parse_bool(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def typed(raw: Column, name: str) -> Column:
    """Text as the declared type; null where it doesn't parse."""
    key = canonical(name)
    kind, pattern, most = _TYPES[key]
    if key == "string":
        return raw
    if key == "boolean":
        return parse_bool(raw)
    fits = raw.rlike(pattern)
    if key == "time":
        hour_ok = raw.rlike("^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?")
        return F.when(fits & hour_ok, raw)
    if key == "datetime":  # the wall clock, whatever the zone
        return F.when(fits, raw.try_cast(kind))
    value = F.when(fits, raw.try_cast(kind))
    return value if most is None else F.when((value >= 0) & (value <= F.lit(str(most)).cast(kind)), value)


def from_typed(column: Column, have: T.DataType, name: str) -> Column:
    """A typed cell (Parquet, ORC) as the declared type, by its text unless the type is the same."""
    if have == spark_type(name) and canonical(name)[:4] != "uint" and canonical(name) != "time":
        return column
    if isinstance(have, (T.TimestampType, T.TimestampNTZType)) and canonical(name) in {"datetime", "date"}:
        return column.cast(spark_type(name))
    return typed(column.cast("string"), name)
