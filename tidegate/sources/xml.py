"""XML: rows are elements of one tag, cells come from selectors."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selectors import xml_steps
from ..session import importable
from ..storage import Files
from .lines import SPLIT
from .streams import parse_files

#: Characters that the parser is given at a time, and bytes of a file that its row's tag is looked for in.
PIECE, LOOK = 1 << 16, 1 << 16


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ET.Element) -> str | None:
    """That of all inside it, trimmed; nothing is null."""
    return ("".join(e.itertext()) if len(e) else e.text or "").strip() or None


def cells(row: ET.Element, paths: Sequence[tuple[list[str], str | None]], value_tag: str | None = None) -> list[str | None]:
    """By each path of xml_steps the first matching child at each step: its attribute or its text."""
    children: dict[str, ET.Element] = {}
    for c in row:
        children.setdefault(_local(c.tag), c)
    out = []
    for steps, attribute in paths:
        e = children.get(steps[0]) if steps else row
        for step in steps[1:]:
            e = next((c for c in e if _local(c.tag) == step), None) if e is not None else None
        if e is None:
            out.append(None)
        elif attribute is not None:
            out.append(e.get(attribute) or None)
        else:
            inner = next((c for c in e if _local(c.tag) == value_tag), None) if value_tag else None
            out.append(_text(e if inner is None else inner))
    return out


def rows_of(text: str, row_tag: str, columns: dict[str, str], namespace: str | None = None, value_tag: str | None = None) -> list[list[str | None]]:
    """A row an element; ValueError for text that isn't XML or has no row."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"xml_parse_error: {e}") from None
    tag = f"{{{namespace}}}{row_tag}" if namespace else row_tag
    found = [e for e in root.iter() if (e.tag == tag if namespace else _local(e.tag) == row_tag)]
    if not found:
        raise ValueError(f"xml_no_rows: no element {row_tag}")
    paths = [xml_steps(s) for s in columns.values()]
    return [cells(e, paths, value_tag) for e in found]


def _select(place: int, keep: int, row_tag: str, columns: dict[str, str], names: list[str], namespace: str | None, value_tag: str | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, cells, row, errors = [], [], [], []
            for i, text in enumerate(part.column(place).to_pylist()):
                try:
                    found, problem = rows_of(text or "", row_tag, columns, namespace, value_tag), None
                except ValueError as e:
                    found, problem = [[None] * len(columns)], str(e)
                at += [i] * len(found)
                row += range(len(found))
                cells += found
                errors += [problem] * len(found)
            cols = [part.column(k).take(pa.array(at, pa.int64())) for k in range(keep)]
            cols += [pa.array([c[k] for c in cells], pa.string()) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row, pa.int64()), pa.array(errors, pa.string())], names=names)

    return run


def select_xml(df: DataFrame, column: str, row_tag: str, columns: dict[str, str], keep: Sequence[str] = (), namespace: str | None = None, value_tag: str | None = None) -> DataFrame:
    """A document a row -> a row an element: keep, the cells, row_index and error. A document that can't
    be read gives one row of nulls with its error."""
    importable(df.sparkSession)
    narrow = df.select(*keep, F.col(column).alias("__xml"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__xml"], *[f"`{c}` string" for c in columns], "row_index long", "error string"])
    names = [*keep, *columns, "row_index", "error"]
    return narrow.mapInArrow(_select(len(keep), len(keep), row_tag, columns, names, namespace, value_tag), schema)


class Elements:
    """The rows of a document that comes in pieces. What has ended is taken out of the tree, so that only
    the elements that are open are held, and the row in which they are."""

    def __init__(self, row_tag: str, columns: dict[str, str], namespace: str | None = None, value_tag: str | None = None):
        self.row_tag, self.namespace, self.value_tag = row_tag, namespace, value_tag
        self.paths = [xml_steps(s) for s in columns.values()]
        self.parser = ET.XMLPullParser(("start", "end"))
        self.open: list[ET.Element] = []
        self.rows, self.any, self.known = 0, False, {}

    def _is_row(self, tag: str) -> bool:
        if (found := self.known.get(tag)) is None:
            found = self.known[tag] = tag == f"{{{self.namespace}}}{self.row_tag}" if self.namespace else _local(tag) == self.row_tag
        return found

    def feed(self, text: bytes, last: bool) -> list[list[str | None]]:
        """Rows in the order of their beginnings."""
        out: list[list[str | None]] = []
        try:
            body = text.decode()
            for at in range(0, len(body), PIECE):
                self.parser.feed(body[at : at + PIECE])
                self._take(out)
            if last:
                self.parser.close()
                self._take(out)
        except (ET.ParseError, UnicodeDecodeError) as e:
            raise ValueError(f"xml_parse_error: {e}") from None
        if last and not self.any:
            raise ValueError(f"xml_no_rows: no element {self.row_tag}")
        return out

    def _take(self, out: list[list[str | None]]) -> None:
        for event, e in self.parser.read_events():
            row = self._is_row(e.tag)
            if event == "start":
                self.open.append(e)
                self.rows += row
                continue
            self.open.pop()
            self.rows -= row
            if self.rows:  # inside a row
                continue
            if row:
                self.any = True
                out += [cells(x, self.paths, self.value_tag) for x in e.iter() if x is e or self._is_row(x.tag)]
            if self.open:
                self.open[-1].remove(e)


def _mark(files: Files, path: str, row_tag: str) -> str:
    """What rows begin with, by the beginning of a file: the tag may have a prefix."""
    found = re.search(rf"<(?:[^\s<>/!?:]+:)?{re.escape(row_tag)}(?=[\s/>])", files.prefix(path, LOOK).decode("utf-8", "ignore"))
    return found[0] if found else f"<{row_tag}"


def read_xml(spark: SparkSession, files: Sequence[tuple[int, str]], row_tag: str, columns: dict[str, str], namespace: str | None = None, value_tag: str | None = None) -> DataFrame:
    """Raw columns, places, and __error for files that can't be read. A file is streamed through one task,
    which holds some of its rows at a time."""
    raw = {f"raw_{c}": s for c, s in columns.items()}
    marks: dict[str, list[tuple[int, str]]] = {}
    known = Files(spark)
    for f, mark in zip(files, known.each(lambda f: _mark(known, f[1], row_tag), files), strict=True):
        marks.setdefault(mark, []).append(f)
    make = partial(Elements, row_tag, raw, namespace, value_tag)
    out = reduce(DataFrame.unionByName, [parse_files(spark, own, mark, make, list(raw)) for mark, own in marks.items()])
    return out.withColumn(SPLIT, F.lit(0).cast("long"))
