"""Writes small Avro files."""

import io
import json
import struct
import zlib
from collections.abc import Sequence
from typing import Any

import pyarrow as pa

from tidegate.sources.avro import MAGIC


def encode(fields: Sequence[tuple[str, Any]], rows: Sequence[dict | None], union: bool = False, codec: str = "null") -> bytes:
    """A small container file of records of strings, longs and doubles, for tests and samples."""

    def long(n: int) -> bytes:
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def cell(kind: Any, v: Any) -> bytes:
        if isinstance(kind, list):
            at = kind.index("null") if v is None else next(i for i, k in enumerate(kind) if k != "null")
            return long(at) + cell(kind[at], v)
        if isinstance(kind, dict):
            return (long(len(v)) + b"".join(cell(kind["items"], x) for x in v) if v else b"") + long(0)
        return {"null": lambda: b"", "string": lambda: long(len(v.encode())) + v.encode(), "long": lambda: long(v), "double": lambda: struct.pack("<d", v)}[kind]()

    root: Any = {"type": "record", "name": "r", "fields": [{"name": n, "type": k} for n, k in fields]}
    body = io.BytesIO()
    for r in rows:
        if union:
            body.write(long(0 if r is None else 1))
        if r is not None:
            for n, k in fields:
                body.write(cell(k, r.get(n)))
    data = body.getvalue()
    if codec == "deflate":
        z = zlib.compressobj(wbits=-15)
        data = z.compress(data) + z.flush()
    elif codec == "snappy":
        data = pa.compress(data, "snappy", asbytes=True) + zlib.crc32(data).to_bytes(4, "big")
    meta = {"avro.schema": json.dumps(["null", root] if union else root), "avro.codec": codec}
    head = MAGIC + long(len(meta)) + b"".join(long(len(k)) + k.encode() + long(len(v)) + v.encode() for k, v in meta.items()) + long(0)
    sync = b"0123456789abcdef"
    return head + sync + long(len(rows)) + long(len(data)) + data + sync
