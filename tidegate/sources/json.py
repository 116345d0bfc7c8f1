"""JSON: an array of objects a file, or an object a line. Cells come from selectors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selectors import select_json
from ..storage import Files
from .lines import AT, FILE_ORD, SPLIT, read_lines
from .streams import parse_files

PARSE, SHAPE, NON_SCALAR = "json_parse_error", "json_shape_error", "json_selector_non_scalar"
_SPACE, _COMMA = re.compile(r"[ \t\n\r]*").match, re.compile(r"[ \t\n\r]*,[ \t\n\r]*").match
_DECODE = json.JSONDecoder(parse_int=str, parse_float=str).raw_decode
#: A text that breaks off so near before its end may be an escape or a literal that goes on.
_NEAR = 16


def _cells(value: Column, columns: dict[str, str], strict: bool) -> tuple[list[Column], Column]:
    """Raw cells, and the error of a row: under strict a selector that finds a container."""
    cells, problem = [], F.lit(None).cast("string")
    for name, selector in columns.items():
        text, container = select_json(value, selector)
        cells.append(text.alias(f"raw_{name}"))
        if strict:
            problem = F.coalesce(problem, F.when(container, F.lit(f"{NON_SCALAR}: {selector}")))
    return cells, problem


def read_ndjson(spark: SparkSession, files: Sequence[tuple[int, str]], columns: dict[str, str], strict: bool = True) -> DataFrame:
    """columns: name -> selector. Blank lines are passed over and not counted. __error is set on rows that
    reject their file: lines that aren't an object, and containers under strict."""
    lines = read_lines(spark, files, F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    cells, problem = _cells(F.col("v"), columns, strict)
    error = F.when(F.col("v").isNull(), PARSE).when(~F.schema_of_variant("v").startswith("OBJECT"), SHAPE).otherwise(problem)
    return lines.select(*cells, FILE_ORD, SPLIT, AT, error.alias("__error"))


class Items:
    """The elements of an array whose text comes in pieces; each as its text and, where it is no element
    but the whole of another value, SHAPE. Elements are only told apart here: the engine parses them."""

    def __init__(self):
        self.rest, self.state, self.enough = "", "start", 0

    def feed(self, text: bytes, last: bool) -> list[tuple[str, str | None]]:
        self.rest += text.decode("utf-8", "replace")
        if len(self.rest) < self.enough and not last:
            return []
        buf, at, out = self.rest, 0, []
        while (at := _SPACE(buf, at).end()) < len(buf):
            match self.state, buf[at]:
                case ("start", "["):
                    self.state, at = "first", at + 1
                case ("start", "\ufeff"):
                    at += 1
                case ("start" | "other", _):  # kept to its end
                    self.state = "other"
                    break
                case ("first", "]") | ("next", "]"):
                    self.state, at = "end", at + 1
                case ("next", ","):
                    self.state, at = "item", at + 1
                case ("first" | "item", _):
                    at, whole = self._items(buf, at, last, out)
                    if not whole:
                        break
                case _:
                    raise ValueError(PARSE)
        self.rest = buf[at:]
        self.enough = 2 * len(self.rest)  # a long element is not tried at each piece of it
        if last and self.state == "other":
            return [(self.rest, SHAPE)]
        if last and self.state != "end":
            raise ValueError(PARSE)
        return out

    def _items(self, buf: str, at: int, last: bool, out: list[tuple[str, str | None]]) -> tuple[int, bool]:
        """Elements from at on, as long as commas follow; where that ends, and whether after an element."""
        while True:
            try:
                end = _DECODE(buf, at)[1]
            except RecursionError:
                raise ValueError(PARSE) from None
            except json.JSONDecodeError as e:
                if last or e.pos < len(buf) - _NEAR and not e.msg.startswith("Unterminated string"):
                    raise ValueError(PARSE) from None
                return at, False
            if end == len(buf) and not last:  # a number may go on
                return at, False
            out.append((buf[at:end], None))
            if not (comma := _COMMA(buf, end)):
                self.state = "next"
                return end, True
            self.state, at = "item", comma.end()
            if at == len(buf):
                return at, False


def read_json_array(spark: SparkSession, files: Sequence[tuple[int, str]], columns: dict[str, str], strict: bool = True) -> DataFrame:
    """A row an object. A file that doesn't parse, or isn't an array of objects, has a row with its
    __error. A file is streamed through one task, which holds some of its elements at a time."""
    items = parse_files(spark, files, "{", Items, ["value", "shape"]).withColumn("v", F.try_parse_json("value"))
    cells, problem = _cells(F.col("v"), columns, strict)
    error = F.coalesce("__error", F.when(F.col("v").isNull(), PARSE), "shape", F.when(~F.schema_of_variant("v").startswith("OBJECT"), SHAPE), problem)
    return items.select(*cells, FILE_ORD, F.lit(0).cast("long").alias(SPLIT), AT, error.alias("__error"))


def _prefixes(files: Files, path: str) -> Iterator[tuple[str, bool]]:
    """Longer and longer beginnings of a file, and whether it ends there."""
    size = 1 << 16
    while True:
        raw = files.prefix(path, size)
        yield raw.decode("utf-8", "ignore").lstrip("\ufeff"), len(raw) < size
        if len(raw) < size:
            return
        size *= 8


def first_keys(files: Files, path: str, array: bool) -> list[str]:
    """The keys of the first object (of the first line that parses): what the schema check compares.
    Only the beginning of the file is read. ValueError if there is none."""
    for text, whole in _prefixes(files, path):
        if array:
            body = text.lstrip(" \t\r\n")
            if body and body[0] != "[":
                try:
                    json.loads(body) if whole else None
                except ValueError:
                    raise ValueError(f"{PARSE}: not JSON") from None
                raise ValueError(f"{SHAPE if body[0] in '{"-0123456789tfn' else PARSE}: the root must be an array of objects with one at least")
            try:
                found, _ = json.JSONDecoder().raw_decode(body[1:].lstrip(" \t\r\n"))
            except ValueError:
                if whole:
                    empty = body[1:].lstrip(" \t\r\n")[:1] == "]"
                    raise ValueError(f"{SHAPE}: the array is empty" if empty else f"{PARSE}: not JSON") from None
                continue
            if not isinstance(found, dict):
                raise ValueError(f"{SHAPE}: the root must be an array of objects with one at least")
            return sorted(found)
        lines = text.split("\n")
        for line in lines if whole else lines[:-1]:
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if isinstance(found, dict):
                return sorted(found)
    raise ValueError(f"{PARSE}: no object")
