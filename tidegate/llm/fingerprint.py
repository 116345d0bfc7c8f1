"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two. So the order of paragraphs doesn't matter, and a paragraph
is inserted or deleted by adding or subtracting its vector, without the rest of the document.

A vector has two blocks. `EQUAL` lanes modulo 2^64 are uniform, drawn from the paragraph's 128-bit
hash: equal sums mean equal multisets. `ALIKE` lanes modulo 2^32 hold a signed count sketch of the
paragraph's `WINDOW`-byte windows; being sums too, they estimate how much two documents share:
1 - |a - b|^2 / (|a|^2 + |b|^2). A text of under 2^31 bytes, Spark's longest, can't make a lane wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, mix, sliced

EQUAL, ALIKE, WINDOW = 8, 256, 16
#: Bytes whose windows are hashed at a time.
BLOCK = 1 << 20
_STEPS = np.arange(1, EQUAL + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class Fingerprint:
    """equal: EQUAL lanes modulo 2^64; alike: ALIKE lanes modulo 2^32."""

    def __init__(self, equal: np.ndarray | None = None, alike: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL, np.uint64) if equal is None else equal
        self.alike = np.zeros(ALIKE, np.int32) if alike is None else alike

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        raw = text.encode("utf-8", "surrogatepass")
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in raw.split(b"\n")), np.uint64).reshape(-1, 2)
        lanes = mix((digests[:, :1] + mix(digests[:, 1:] + _STEPS)).ravel()).reshape(-1, EQUAL)
        return cls(lanes.sum(0, dtype=np.uint64), _sketch(raw))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.alike + other.alike)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.alike - other.alike)

    def __str__(self) -> str:
        return self.equal.astype("<u8").tobytes().hex() + self.alike.astype("<i4").tobytes().hex()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and str(self) == str(other)

    __hash__ = None

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw, "<u8", EQUAL).copy(), np.frombuffer(raw, "<i4", ALIKE, 8 * EQUAL).copy())

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, and for those alone."""
        if (self.equal == other.equal).all() and (self.alike == other.alike).all():
            return 1.0
        a, b = self.alike.astype(np.float64), other.alike.astype(np.float64)
        both = float(a @ a + b @ b)
        return min(max(0.0, 1 - float((a - b) @ (a - b)) / both), 1 - 1e-9) if both else 0.0


def _counted(h: np.ndarray) -> np.ndarray:
    """The sketch of window hashes: a lane and a sign from each."""
    at = (h >> np.uint64(55)).astype(np.int64)  # 9 bits: the lane and the sign
    n = np.bincount(at, minlength=2 * ALIKE)
    return (n[:ALIKE] - n[ALIKE:]).astype(np.int32)  # modulo 2^32


def _sketch(raw: bytes) -> np.ndarray:
    """Windows that lie within one paragraph; a paragraph under WINDOW bytes is one window."""
    out = np.zeros(ALIKE, np.int32)
    for at in range(0, len(raw), BLOCK):
        own = np.frombuffer(raw[at : at + BLOCK + WINDOW - 1], np.uint8)
        if own.size < WINDOW:
            continue
        words = np.ndarray((own.size - 7,), "<u8", own.tobytes(), 0, (1,))
        n = own.size - WINDOW + 1
        h = mix(words[:n]) + words[8 : 8 + n]
        breaks = np.concatenate(([0], np.cumsum(own == 10)))
        out += _counted(mix(h[breaks[WINDOW:] == breaks[:-WINDOW]]))
    if short := [p for p in raw.split(b"\n") if 0 < len(p) < WINDOW]:
        out += _counted(np.array([xxhash.xxh3_64_intdigest(p) for p in short], np.uint64))
    return out


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and in order, each bucket's follower (own false) last."""
    held: tuple | None = None
    for part in sliced(parts):
        rows = []
        for bucket, own, doc, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "own", "doc_id", "text")), strict=True):
            text = text or ""
            now = (bucket, doc, text, Fingerprint.of(text))
            if held and held[0] == bucket:
                _, last_doc, last, print_ = held
                changed = edited_text(last, text)
                other = Fingerprint.of(changed)
                rows.append((last_doc, len(last), changed, str(print_), str(other), print_.likeness(other), print_.likeness(now[3])))
            held = now if own else None
        cols = list(zip(*rows, strict=True)) or [[] for _ in OUT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n_chars, edited (the edited text), fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the next in descending doc_id, and the first after the last; rows that share a
    doc_id go by text, null ids come last. Of one row alone the next is itself. A null text reads as the
    empty text, whose one paragraph is empty. An empty table gives no rows. Other columns aren't read.

    Rows are dealt to ranges of doc_id whose bounds are quantiles; the first row of a range also goes to
    the range before it. So every neighbour is met with one shuffle and no global sort.
    """
    spark = importable(docs.sparkSession)
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)})
    heads = docs.select("doc_id").mapInArrow(_heads(bounds), "bucket int, head long").groupBy("bucket").agg(F.max("head").alias("head")).collect()  # one row a range
    heads = sorted((r["bucket"], r["head"]) for r in heads)
    follows = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    met = docs.mapInArrow(_dealt(bounds, follows), "bucket int, doc_id long, text string, own boolean")
    met = met.repartition("bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))
    return met.mapInArrow(_compare, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _bucket(column: pa.Array, bounds: list[int]) -> np.ndarray:
    """0 for the largest ids, up to the number of bounds; one more for null."""
    ids = np.array([0 if x is None else x for x in column.to_pylist()], np.int64)
    out = len(bounds) - np.searchsorted(np.array(bounds, np.int64), ids, "right")
    return np.where(np.array(column.is_null()), len(bounds) + 1, out).astype(np.int32)


def _heads(bounds: list[int]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best: dict[int, int | None] = {}
            for b, x in zip(_bucket(part.column(0), bounds).tolist(), part.column(0).to_pylist(), strict=True):
                best[b] = x if best.get(b) is None else max(best[b], x)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["bucket", "head"])

    return run


def _dealt(bounds: list[int], follows: dict[int | None, int]):
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("own", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, text = part.column("doc_id"), part.column("text").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(ids, bounds)), ids, text, pa.array([True] * len(ids), pa.bool_())], schema=schema)
            at = [i for i, x in enumerate(ids.to_pylist()) if x in follows]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([follows[ids[i].as_py()] for i in at], pa.int32()), ids.take(at), text.take(at), pa.array([False] * len(at), pa.bool_())], schema=schema)

    return run
