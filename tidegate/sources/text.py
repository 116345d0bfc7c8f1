"""Delimited text: CSV and TSV, all cells as text."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Files, plain
from .lines import literal, running, with_file

#: Bytes that a header is looked for in, at first and at most.
PREFIX, LONGEST = 1 << 16, 1 << 24


@dataclass(frozen=True)
class Delimited:
    separator: str = ";"
    header: bool = True
    null_values: tuple[str, ...] = ("",)
    encoding: str = "UTF-8"


def first_record(raw: bytes, separator: str) -> list[str] | None:
    """The cells of the first record, which quoted line breaks may be in; None if raw ends before it."""
    text = raw.decode("utf-8", "replace").lstrip("﻿")
    end, quotes = -1, 0
    while (end := text.find("\n", end + 1)) >= 0:
        quotes = text.count('"', 0, end)
        if quotes % 2 == 0 and text[:end].strip("\r\n"):
            return next(csv.reader([text[:end].strip("\r\n")], delimiter=separator))
    return None


def header_of(files: Files, path: str, options: Delimited, declared: Sequence[str]) -> list[str]:
    """The file's columns, from its first record; without a header the declared names in order, and
    extra_column_N for what is left over. ValueError for an empty file that should have a header."""
    size, cells = PREFIX, None
    while cells is None:
        raw = files.prefix(path, size)
        whole = len(raw) < size
        cells = first_record(raw + b"\n" if whole else raw, options.separator)
        if cells is None and whole:
            if options.header:
                raise ValueError("csv_header_error: the file is empty")
            return list(declared)
        if cells is None and size >= LONGEST:
            raise ValueError(f"csv_header_error: no line ends in the first {size} bytes")
        size *= 16
    if options.header:
        return cells
    return [*declared[: len(cells)], *[f"extra_column_{i + 1}" for i in range(len(cells) - len(declared))]]


def broken_lines(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """The files, as Files.key has them, with an odd number of quotes in some line: only these can have
    quoted line breaks. A scan of raw lines, without parsing."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = spark.read.text(literal(paths)).where(odd).select("_metadata.file_path").distinct()
    return {plain(r[0]) for r in found.collect()}  # a row a file


def read_delimited(spark: SparkSession, files: Sequence[tuple[int, str]], columns: Sequence[str], options: Delimited = Delimited(), wanted: Sequence[str] | None = None) -> DataFrame:
    """Files, (position, path), with these columns, in this order: raw_<column> as text (of the wanted
    ones), the rows' places, and __long: whether the row has more cells than columns. Cells among
    null_values, and the missing cells of short rows, are null.

    Files are split between tasks, but for those with quoted line breaks, which are read in one task
    each. Blank lines are passed over.
    """
    if len(options.separator.encode()) != 1:
        raise ValueError("separator must be a single byte")
    known = Files(spark)
    broken = broken_lines(spark, [p for _, p in files])
    whole = [(i, p) for i, p in files if known.key(p) in broken] if broken else []
    plain_files = [(i, p) for i, p in files if known.key(p) not in broken] if broken else files
    out = [_read(spark, own, columns, options, wanted, multi) for own, multi in ((plain_files, False), (whole, True)) if own]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _read(spark: SparkSession, files: Sequence[tuple[int, str]], columns: Sequence[str], options: Delimited, wanted: Sequence[str] | None, multi: bool) -> DataFrame:
    schema = ", ".join([*[f"`c{i}` string" for i in range(len(columns))], "`__bad` string"])
    scan = spark.read.schema(schema).options(sep=options.separator, header=options.header, encoding=options.encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", columnPruning=False, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quote='"', escape='"', multiLine=multi, nullValue="\u0000", emptyValue="").csv(literal(p for _, p in files))
    missing = F.col("__bad").isNotNull()

    def cell(c):
        """Empty cells come as null, as do missing ones."""
        full = c if "" in options.null_values else F.coalesce(c, F.when(~missing, F.lit("")))
        return F.when(~full.isin(*options.null_values), full) if options.null_values else full

    separators = F.length(_bare()) - F.length(F.replace(_bare(), F.lit(options.separator), F.lit("")))
    surplus = F.coalesce(missing & (separators >= len(columns)), F.lit(False))
    cells = [cell(F.col(f"c{i}")).alias(f"raw_{name}") for i, name in enumerate(columns) if wanted is None or name in wanted]
    return with_file(scan, files, [*cells, surplus.alias("__long"), running()], split=True)


def _bare():
    """A malformed record without its quoted stretches."""
    return F.regexp_replace("__bad", '"(?:[^"]|"")*"', "")
