"""Lines that several documents share, kept in one of them: sharded minimal perfect hashes.

1. Each document's line keys are hashed to 128 bits and pre-aggregated, per batch and then by Spark,
   to (number of documents, smallest doc_id). 2. The keys of two documents or more are dealt by hash to
   shards; a shard becomes one row: a minimal perfect hash over its keys (of all 128 bits) and, in its order, arrays of
   64-bit fingerprints, document counts and owners. Keys of one document lose no line, so they are left
   out; a probe with such a key meets a foreign fingerprint. 3. Documents probe: their line hashes,
   as blobs by shard, meet the shard's one row, and what must go comes back by document.
   The most frequent keys (at most `HOT`, a fixed bound) travel to the tasks as a small array instead,
   so a line that a third of all documents hold is settled where the document is. 4. Documents meet
   their list of keys to drop and are rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, batches, mix, sliced, texts

#: Keys in the small array of frequent keys, at most: 24 bytes each.
HOT = 4096
#: Keys in a shard, on average: its arrays take about 6 MB.
SHARD_KEYS = 1 << 18
#: The place of a null doc_id in the order: after every other.
NO_ID = (1 << 63) - 1
KEYS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("owner", pa.int64()), ("last", pa.int64())])
SHARDS = pa.schema([("shard", pa.int64()), ("seed", pa.int64()), ("levels", pa.binary()), ("sizes", pa.list_(pa.int64())), ("prints", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])
PROBES = pa.schema([("shard", pa.int64()), ("probes", pa.binary())])
DROPS = pa.schema([("key_id", pa.int64()), ("h", pa.int64())])
_SEED = 0xD6E8FEB86659FD93


# --- the hash -------------------------------------------------------------------------------------
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit levels, each with the keys that were alone
    on their bit; a key's index is the rank of its bit. About 3.7 bits a key at two bits a slot."""

    def __init__(self, levels: np.ndarray, sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self.before = np.concatenate(([0], np.cumsum(self.levels, dtype=np.int64)))
        self.starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(_SEED * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """ValueError if a key comes twice: no level could tell the two apart."""
        levels, sizes, rest = [], [], np.asarray(keys, np.uint64)
        if np.unique(rest).size < rest.size:
            raise ValueError("a perfect hash needs distinct keys")
        while rest.size:
            size = 2 * rest.size + 1
            at = cls._slots(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            rest = rest[~alone[at]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, bool), sizes)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of keys; -1 or any index for others, which fingerprints tell apart."""
        out = np.full(keys.size, -1, np.int64)
        rest = np.arange(keys.size)
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self._slots(keys[rest], level, size)
            hit = self.levels[at]
            out[rest[hit]] = self.before[at[hit]]
            rest = rest[~hit]
            if not rest.size:
                break
        return out


def joint(h: np.ndarray, g: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit key of both halves of a line's hash. Two lines may share it under one seed, not under
    all."""
    return mix(h.view(np.uint64) + np.uint64(_SEED * (2 * seed + 1) % 2**64)) ^ g.view(np.uint64)


# --- keys of lines --------------------------------------------------------------------------------
def line_key(line: str, least: int) -> bytes | None:
    """The key in UTF-8; None if it has under `least` code points."""
    key = line.strip(" \t\n\x0b\x0c\r")
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= least else None


def _hashed(text: str, least: int) -> tuple[list[str], list[int], list[bytes]]:
    """Lines, the places of those with a key, and the keys' 16-byte hashes."""
    lines = text.split("\n")
    at, out = [], []
    for i, line in enumerate(lines):
        if (key := line_key(line, least)) is not None:
            at.append(i)
            out.append(xxhash.xxh3_128_digest(key))
    return lines, at, out


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _ids(column: pa.Array) -> list[int]:
    return [NO_ID if x is None else x for x in column.to_pylist()]


def _keys(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen: dict[bytes, list[int]] = {}
            for doc, text in zip(_ids(part.column("doc_id")), texts(part.column("text")), strict=True):
                for d in set(_hashed(text, least)[2]):
                    if (x := seen.get(d)) is None:
                        seen[d] = [1, doc, doc]
                    else:
                        x[0] += 1
                        x[1], x[2] = min(x[1], doc), max(x[2], doc)
            pairs, values = _pairs(list(seen)).view(np.int64), np.array(list(seen.values()), np.int64).reshape(-1, 3)
            yield batches({"h": pairs[:, 0], "g": pairs[:, 1], "n": values[:, 0], "owner": values[:, 1], "last": values[:, 2]}, KEYS)

    return run


def _build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> one row a shard. A task holds one shard at a time."""

    def row(shard: int, cols: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, g, n, owner = (np.concatenate(c) for c in cols)
        seed = next(s for s in count() if np.unique(joint(h, g, s)).size == h.size)  # (h, g) are distinct
        keys = joint(h, g, seed)
        hashed = PerfectHash.build(keys)
        at = hashed.index(keys)
        prints, counts, owners = np.empty(h.size, np.int64), np.empty(h.size, np.uint32), np.empty(h.size, np.int64)
        prints[at], owners[at] = g, owner
        counts[at] = np.minimum(n, 2**32 - 1)
        return batches({"shard": [shard], "seed": [seed], "levels": [np.packbits(hashed.levels).tobytes()], "sizes": [hashed.sizes], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()]}, SHARDS)

    now, held = None, [[], [], [], []]
    for part in parts:
        shard = part.column("shard").to_numpy()
        cols = [part.column(c).to_numpy() for c in ("h", "g", "n", "owner")]
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if shard.size else []
        for a, b in zip(cuts, [*cuts[1:], shard.size], strict=True):
            if now is not None and shard[a] != now:
                yield row(now, held)
                held = [[], [], [], []]
            now = int(shard[a])
            for to, c in zip(held, cols, strict=True):
                to.append(c[a:b])
    if now is not None:
        yield row(now, held)


class _Hot:
    """The frequent keys, sorted by h, with print and owner."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.h, self.g, self.owner = (np.array([r[i] for r in rows], np.int64) for i in range(3))

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (h, g): whether it is frequent, and its owner."""
        if not self.h.size or not len(pairs):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        at = np.searchsorted(self.h, pairs[:, 0])
        at[at == self.h.size] = 0
        return (self.h[at] == pairs[:, 0]) & (self.g[at] == pairs[:, 1]), self.owner[at]


def _probes(least: int, shards: int, hot: _Hot):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found, owners = [], []
            for doc, text in zip(_ids(part.column("doc_id")), texts(part.column("text")), strict=True):
                new = list(set(_hashed(text, least)[2]))
                found += new
                owners += [doc] * len(new)
            pairs = _pairs(found).view(np.int64)
            known, _ = hot.find(pairs)
            rows = np.column_stack([pairs, np.array(owners, np.int64).reshape(-1)])[~known]
            shard = (mix(rows[:, 1].view(np.uint64)) % np.uint64(shards)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            order = np.argsort(shard, kind="stable")
            rows, shard = rows[order], shard[order]
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if shard.size else np.zeros(0, np.int64)
            ends = [*cuts[1:], shard.size] if shard.size else []
            yield batches({"shard": shard[cuts], "probes": [rows[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]}, PROBES)

    return run


def _answers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, each shard's arrays (a row without probes) before its probes."""
    hashed, prints, owners = PerfectHash.build(np.zeros(0, np.uint64)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    now = seed = None
    for part in parts:
        ids, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(part.num_rows):
            shard = part.column("shard")[i].as_py()
            if not part.column("probes")[i].is_valid:
                now, seed, sizes = shard, part.column("seed")[i].as_py(), part.column("sizes")[i].as_py()
                hashed = PerfectHash(np.unpackbits(np.frombuffer(part.column("levels")[i].as_py(), np.uint8), count=sum(sizes)).astype(bool), sizes)
                prints, owners = (np.frombuffer(part.column(c)[i].as_py(), np.int64) for c in ("prints", "owners"))
            elif now == shard:  # else the shard is empty
                rows = np.frombuffer(part.column("probes")[i].as_buffer(), np.int64).reshape(-1, 3)
                at = hashed.index(joint(np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1]), seed))
                gone = (at >= 0) & (prints[at] == rows[:, 1]) & (owners[at] != rows[:, 2])
                ids.append(rows[gone, 2])
                hs.append(rows[gone, 0])
        yield batches({"key_id": np.concatenate(ids), "h": np.concatenate(hs)}, DROPS)


def _rewrite(least: int, hot: _Hot, schema: pa.Schema, sizes: tuple[str, str] | None, chars: str | None):
    """Drops what must go. The batch has the documents' columns, then the keys to drop."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            out, total, dropped = [], [], []
            drops = part.column(part.num_columns - 1)
            nulls = part.column("text").is_null().to_pylist()
            for i, (doc, text) in enumerate(zip(_ids(part.column("doc_id")), texts(part.column("text")), strict=True)):
                lines, at, digests = _hashed(text, least)
                pairs = _pairs(digests).view(np.int64)
                known, owner = hot.find(pairs)
                gone = known & (owner != doc)
                if drops[i].is_valid:
                    gone |= np.isin(pairs[:, 0], drops[i].values.to_numpy())
                bad = {at[j] for j in np.flatnonzero(gone)}
                total.append(len(lines))
                dropped.append(len(bad))
                out.append(text if not bad and not nulls[i] else None if nulls[i] and not sizes else "\n".join(x for j, x in enumerate(lines) if j not in bad))
            cols = {f.name: part.column(f.name) for f in schema if f.name in part.schema.names[:-1]}
            cols["text"] = pa.array(out, pa.string())
            if sizes:
                cols |= {sizes[0]: pa.array(total, pa.int64()), sizes[1]: pa.array(dropped, pa.int64())}
            if chars:
                cols[chars] = pa.array([None if t is None else len(t) for t in out], schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def dedup_lines(docs: DataFrame, least_chars: int = 10, counts: bool = True) -> DataFrame:
    """docs with every line that another document of smaller doc_id also holds left out of text.

    A line's key: stripped of ASCII white space, A-Z lower-cased. Keys of `least_chars` code points or
    more that two documents hold lose all their lines except in the smallest doc_id. counts: the result
    is doc_id, text, n_lines, n_dropped, and a null text reads as one empty line; else it has the
    columns of docs, a null text stays null, and n_chars, if there, is counted anew.

    Rows with one doc_id are one document. A null doc_id comes after all others. Empty tables give no
    rows. Other columns, of any name, are passed on or, with counts, left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = base.mapInArrow(_keys(least_chars), "h long, g long, n long, owner long, last long").groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"), F.max("last").alias("last")).where("owner < last").select("h", "g", "n", "owner")
    keys = scratch.keep(keys)
    total, lines = keys.agg(F.count("*"), F.sum("n")).first()
    #: Under HOT keys can have more than this many documents.
    hot_from = max(64, (lines or 0) // HOT + 1)
    hot = _Hot([tuple(r) for r in keys.where(F.col("n") >= hot_from).select("h", "g", "owner").collect()])
    shards = max(2 * parts, -(-total // SHARD_KEYS))
    cold = keys.where(F.col("n") < hot_from).select(F.expr("0L").alias("shard"), "h", "g", "n", "owner")
    cold = cold.mapInArrow(_dealt(shards), "shard long, h long, g long, n long, owner long")
    built = cold.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, "shard long, seed long, levels binary, sizes array<long>, prints binary, counts binary, owners binary")
    built = scratch.keep(built)
    scratch.drop(keys)
    probes = base.mapInArrow(_probes(least_chars, shards, hot), "shard long, probes binary")
    met = built.drop("counts").unionByName(probes, allowMissingColumns=True)
    drops = met.repartition("shard").sortWithinPartitions("shard", F.col("probes").isNotNull()).mapInArrow(_answers, "key_id long, h long").groupBy("key_id").agg(F.collect_set("h").alias("__tidegate_drops"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if counts else docs
    met = rows.withColumn("__tidegate_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(drops.withColumnRenamed("key_id", "__tidegate_key"), "__tidegate_key", "left").drop("__tidegate_key")
    schema = StructType([*rows.schema, *([StructField("n_lines", LongType()), StructField("n_dropped", LongType())] if counts else [])])
    arrow = to_arrow_schema(schema)
    chars = "n_chars" if not counts and "n_chars" in docs.columns else None
    return met.mapInArrow(_rewrite(least_chars, hot, arrow, ("n_lines", "n_dropped") if counts else None, chars), schema)


def _dealt(shards: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            g = part.column("g").to_numpy()
            shard = (mix(g.view(np.uint64)) % np.uint64(shards)).astype(np.int64) if g.size else g
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *part.columns[1:]], names=part.schema.names)

    return run
