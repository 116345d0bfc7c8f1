"""Files of one value each (JSON arrays, XML), read as a stream: Spark cuts them into short stretches, and
one task puts a file's stretches in order and feeds them to a parser that gives rows as it goes. So no
task holds a file; the cuts lie wherever a mark stands and mean nothing to the parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from .lines import AT, FILE_ORD, SPLIT, literal, running, with_file

#: Names of files whose size is not their text's.
PACKED = re.compile(r"\.(gz|gzip|bz2|zst|zstd|lz4|lzo|snappy|deflate|xz|br)$", re.I)


class Parser(Protocol):
    """Of one file. feed() gives the rows that are whole by now; ValueError says why the file is rejected."""

    def feed(self, text: bytes, last: bool) -> list[Sequence[str | None]]: ...


def stretches(spark: SparkSession, files: Sequence[tuple[int, str]], mark: str) -> DataFrame:
    """FILE_ORD, value and __size: the files, cut before each mark, which is left out. A file's stretches
    are in order in one partition, after a null that begins it (an empty file has nothing else). A mark at
    a file's very end shows in its size only; that null's is -1 where the file is compressed, else 0."""
    scan = spark.read.option("lineSep", mark).text(literal(p for _, p in files))
    cut = with_file(scan, files, [F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("__size"), running()], split=True)
    heads = spark.createDataFrame([(i, -1 if PACKED.search(p) else 0) for i, p in files], f"{FILE_ORD} long, __size long").select(F.lit(None).cast("binary").alias("value"), "__size", F.lit(0).cast("long").alias(AT), F.lit(-1).cast("long").alias(SPLIT), FILE_ORD)
    parts = min(len(files), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = cut.unionByName(heads).repartitionById(parts, F.pmod(FILE_ORD, F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions(FILE_ORD, SPLIT, AT).select(FILE_ORD, "value", "__size")


class _Rows:
    """What is found, by column, until it makes a batch."""

    def __init__(self, names: Sequence[str]):
        self.names = names
        self.clear()

    def clear(self) -> None:
        self.files, self.at, self.cells, self.problems = [], [], [], []

    def add(self, file: int, at: int, cells: Sequence[Sequence[str | None]], problem: str | None = None) -> None:
        self.files += [file] * len(cells)
        self.at += range(at, at + len(cells))
        self.cells += cells
        self.problems += [problem] * len(cells)

    def batch(self) -> pa.RecordBatch:
        cells = [pa.array([c[k] for c in self.cells], pa.string()) for k in range(len(self.names) - 3)]
        out = pa.RecordBatch.from_arrays([pa.array(self.files, pa.int64()), *cells, pa.array(self.at, pa.int64()), pa.array(self.problems, pa.string())], names=self.names)
        self.clear()
        return out


def _parsed(mark: bytes, make: Callable[[], Parser], names: Sequence[str]):
    width = len(names) - 3

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(names)
        file, parser, n, begun, packed, size, read = -1, None, 0, False, False, 0, 0

        def feed(text: bytes, last: bool) -> None:
            nonlocal parser, n
            if parser is None:
                return
            try:
                found = parser.feed(text, last)
                rows.add(file, n, found)
                n += len(found)
            except ValueError as e:
                rows.add(file, n, [[None] * width], str(e))
                parser = None

        def end() -> None:
            """Spark takes three bytes of a byte order mark off."""
            if begun and not packed and (size - read == len(mark) != 3 or size - read == len(mark) + 3):
                feed(mark, False)
            feed(b"", True)

        for part in parts:
            files, values = part.column(0).to_pylist(), part.column(1).to_pylist()
            heads = [k for k, v in enumerate(values) if v is None]
            for a, b in zip([0, *heads], [*heads, len(values)], strict=True):
                if a < b and values[a] is None:
                    end()
                    file, parser, n, begun, packed, size, read = files[a], make(), 0, False, part.column(2)[a].as_py() < 0, 0, 0
                    a += 1
                if a < b:
                    text = mark.join(values[a:b])
                    text = mark + text if begun else text
                    feed(text, False)
                    begun, size, read = True, part.column(2)[a].as_py(), read + len(text)
            if rows.at:
                yield rows.batch()
        end()
        if rows.at:
            yield rows.batch()

    return run


def parse_files(spark: SparkSession, files: Sequence[tuple[int, str]], mark: str, make: Callable[[], Parser], columns: Sequence[str]) -> DataFrame:
    """FILE_ORD, columns, AT (the row's number in its file) and __error: set on the last row of a file that
    is rejected, which has no cells."""
    importable(spark)
    schema = ", ".join([f"{FILE_ORD} long", *[f"`{c}` string" for c in columns], f"{AT} long", "__error string"])
    return stretches(spark, files, mark).mapInArrow(_parsed(mark.encode(), make, [FILE_ORD, *columns, AT, "__error"]), schema)
