"""Avro object container files, read by the published format."""

from __future__ import annotations

import bz2
import json
import lzma
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from ..storage import Files
from .lines import AT, FILE_ORD, SPLIT, whole_files

MAGIC = b"Obj\x01"
CODECS = ("null", "deflate", "snappy", "zstandard", "bzip2", "xz")


class Reader:
    """Values of a binary stream by schema."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.names = raw, 0, {}

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("avro_parse_error: the file ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def blocks(self) -> Iterator[None]:
        """Once for each item of an array's or map's blocks."""
        while n := self.long():
            if n < 0:
                self.long()
            for _ in range(abs(n)):
                yield

    def learn(self, schema: Any) -> None:
        """Remembers named types."""
        if isinstance(schema, list):
            for s in schema:
                self.learn(s)
        elif isinstance(schema, dict):
            if "name" in schema:
                self.names[schema["name"].rpartition(".")[2]] = schema
            for s in [f["type"] for f in schema.get("fields", [])] + [schema[k] for k in ("items", "values") if k in schema] + ([schema["type"]] if isinstance(schema.get("type"), (dict, list)) else []):
                self.learn(s)

    def value(self, schema: Any) -> Any:
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        kind = schema["type"] if isinstance(schema, dict) else schema
        match kind:
            case "null":
                return None
            case "boolean":
                return self.take(1) == b"\x01"
            case "int" | "long":
                return self.long()
            case "float":
                return struct.unpack("<f", self.take(4))[0]
            case "double":
                return struct.unpack("<d", self.take(8))[0]
            case "bytes":
                return self.take(self.long())
            case "string":
                return self.take(self.long()).decode()
            case "fixed":
                return self.take(schema["size"])
            case "enum":
                return schema["symbols"][self.long()]
            case "array":
                return [self.value(schema["items"]) for _ in self.blocks()]
            case "map":
                return {self.take(self.long()).decode(): self.value(schema["values"]) for _ in self.blocks()}
            case "record":
                return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
            case dict() | list():
                return self.value(kind)
        named = self.names.get(str(kind).rpartition(".")[2])
        if named is None:
            raise ValueError(f"avro_parse_error: unknown type {kind}")
        return self.value(named)


def unpacked(body: bytes, codec: str) -> bytes:
    """A block's bytes."""
    match codec:
        case "null":
            return body
        case "deflate":
            return zlib.decompress(body, -15)
        case "bzip2":
            return bz2.decompress(body)
        case "xz":
            return lzma.decompress(body)
        case "zstandard":
            return pa.CompressedInputStream(pa.BufferReader(body), "zstd").read()
    size = shift = 0  # snappy: the size as a varint, the data, and four bytes of checksum
    for b in body:
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    out = pa.decompress(body[:-4], size, "snappy", asbytes=True)
    if zlib.crc32(out) != int.from_bytes(body[-4:], "big"):
        raise ValueError("avro_parse_error: a block's checksum is wrong")
    return out


def records(raw: bytes) -> tuple[list[str], Iterator[dict | None]]:
    """The root record's fields, and the records; a root union of null and a record may give None."""
    if raw[:4] != MAGIC:
        raise ValueError("avro_parse_error: not an object container file")
    head = Reader(raw)
    head.at = 4
    meta = {head.take(head.long()).decode(): head.take(head.long()) for _ in head.blocks()}
    sync, codec = head.take(16), meta.get("avro.codec", b"null").decode()
    schema = json.loads(meta["avro.schema"])
    roots = [s for s in (schema if isinstance(schema, list) else [schema]) if isinstance(s, dict) and s.get("type") == "record"]
    if len(roots) != 1 or codec not in CODECS:
        raise ValueError(f"avro_parse_error: the root must be one record, the codec one of {', '.join(CODECS)}")

    def each() -> Iterator[dict | None]:
        while head.at < len(raw):
            count, size = head.long(), head.long()
            body = head.take(size)
            block = Reader(unpacked(body, codec))
            block.learn(schema)
            for _ in range(count):
                yield block.value(schema)
            if head.take(16) != sync:
                raise ValueError("avro_parse_error: a block's mark is wrong")

    return [f["name"] for f in roots[0]["fields"]], each()


def text_of(value: Any, strict: bool) -> str | None:
    """Scalars as text, logical dates as their numbers; containers are an error under strict."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if strict:
        raise ValueError("avro_non_scalar: an array, map or record in a declared column")
    return json.dumps(value, ensure_ascii=False, default=str, separators=(",", ":"))


def _read(columns: dict[str, str], strict: bool, names: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                cells, problem = [], None
                try:
                    _, found = records(part.column("content")[i].as_py())
                    cells = [[text_of((r or {}).get(s), strict) for s in columns.values()] for r in found]
                except (ValueError, KeyError, IndexError, OSError, EOFError, struct.error, zlib.error, lzma.LZMAError) as e:
                    cells, problem = [[None] * len(columns)], str(e)
                n = len(cells)
                cols = [part.column(FILE_ORD).take(pa.array([i] * n, pa.int64()))]
                cols += [pa.array([c[k] for c in cells], pa.string()) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(n), pa.int64()), pa.array([problem] * n, pa.string())], names=names)

    return run


def read_avro(spark: SparkSession, files: Sequence[tuple[int, str]], columns: dict[str, str], strict: bool = True) -> DataFrame:
    """columns: name -> field. Raw columns, places, and __error for files that can't be read. A file is
    decoded in one task."""
    importable(spark)
    schema = ", ".join([f"{FILE_ORD} long", *[f"`raw_{c}` string" for c in columns], f"{AT} long, __error string"])
    names = [FILE_ORD, *[f"raw_{c}" for c in columns], AT, "__error"]
    read = whole_files(spark, "binaryFile", files, "content").select("content", FILE_ORD).mapInArrow(_read(columns, strict, names), schema)
    return read.withColumn(SPLIT, F.lit(0).cast("long"))


def columns_of(files: Files, path: str) -> list[str]:
    """From the file's head alone. ValueError if it can't be read."""
    size = 1 << 16
    while True:
        raw = files.prefix(path, size)
        try:
            return records(raw)[0]
        except (ValueError, KeyError) as x:
            if len(raw) < size or raw[:4] != MAGIC:
                raise ValueError(str(x)) from None
        size *= 8
