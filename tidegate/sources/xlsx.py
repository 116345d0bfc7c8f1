"""XLSX: a sheet of an Office Open XML workbook, cells as text."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from .lines import AT, FILE_ORD, SPLIT, whole_files

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def sheet(raw: bytes, name: str | None = None) -> dict[int, dict[int, str]]:
    """Rows by 1-based number, cells by 0-based column; of the named sheet, or the first."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        sheets = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        chosen = next((s for s in sheets if name is None or s.get("name") == name), None)
        if chosen is None:
            raise ValueError(f"xlsx_sheet_error: no sheet {name}")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[chosen.get(_REL)].lstrip("/")
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        out: dict[int, dict[int, str]] = {}
        for i, row in enumerate(ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row")):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                kind, v = c.get("t"), c.findtext(f"{_MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None:
                    continue
                else:
                    text = shared[int(v)] if kind == "s" else ("true" if v == "1" else "false") if kind == "b" else v
                cells[_column(c.get("r")) if c.get("r") else k] = text
            out[int(row.get("r") or i + 1)] = cells
        return out
    except (KeyError, IndexError, zipfile.BadZipFile, ET.ParseError) as e:
        raise ValueError(f"xlsx_parse_error: {e}") from None


def header(rows: dict[int, dict[int, str]], at: int) -> list[str]:
    """The columns' names: blank ones are column_N, repeats get _dup_K."""
    cells, out = rows.get(at, {}), []
    seen: dict[str, int] = {}
    for i in range(max(cells, default=-1) + 1):
        name = cells.get(i, "").strip() or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_dup_{seen[name] - 1}")
    return out


def _read(columns: Sequence[str], sheet_name: str | None, header_row: int, data_row: int, names: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                rows = sheet(part.column("content")[i].as_py(), sheet_name)
                place = {n: k for k, n in enumerate(header(rows, header_row))}
                found = [r for n, r in sorted(rows.items()) if n >= data_row and r]
                cols = [part.column(FILE_ORD).take(pa.array([i] * len(found), pa.int64()))]
                cols += [pa.array([r.get(place.get(c, -1)) or None for r in found], pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(len(found)), pa.int64())], names=names)

    return run


def read_xlsx(spark: SparkSession, files: Sequence[tuple[int, str]], columns: Sequence[str], sheet_name: str | None = None, header_row: int = 1, data_row: int = 2) -> DataFrame:
    """Raw columns and places. A file that can't be read ends the run; the look at its header rejects it
    before. A workbook is parsed in one task."""
    importable(spark)
    names = [FILE_ORD, *[f"raw_{c}" for c in columns], AT]
    schema = ", ".join([f"{FILE_ORD} long", *[f"`raw_{c}` string" for c in columns], f"{AT} long"])
    read = whole_files(spark, "binaryFile", files, "content").select("content", FILE_ORD).mapInArrow(_read(columns, sheet_name, header_row, data_row, names), schema)
    return read.withColumn(SPLIT, F.lit(0).cast("long"))


def headers(spark: SparkSession, files: Sequence[tuple[int, str]], sheet_name: str | None = None, header_row: int = 1) -> dict[int, list[str] | ValueError]:
    """The files' columns by position, or why they can't be read. One job: a workbook must be unpacked
    as a whole, which no driver should do."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found, errors = [], []
            for raw in part.column("content"):
                try:
                    found.append(header(sheet(raw.as_py(), sheet_name), header_row))
                    errors.append(None)
                except ValueError as x:
                    found.append([])
                    errors.append(str(x))
            yield pa.RecordBatch.from_arrays([part.column(FILE_ORD), pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())], names=[FILE_ORD, "names", "error"])

    importable(spark)
    rows = whole_files(spark, "binaryFile", files, "content").mapInArrow(run, f"{FILE_ORD} long, names array<string>, error string")
    return {r[0]: ValueError(r[2]) if r[2] else r[1] for r in rows.collect()}  # a row a file
