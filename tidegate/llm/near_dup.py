"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets,
star-shaped candidate edges, links confirmed on full shingle sets.

How nothing is lost although buckets emit stars and not all pairs: texts with equal shingle sets are
one node. Links are looked for in three rounds, with the components of what is confirmed after each.
1. each node with the smallest hub among its buckets (one pair a node); 2. all stars of the buckets
that still hold two components; 3. in those that do so even then, pairs that cross components, by blocks
of `BLOCK` x `BLOCK` members (a task's work is a few blocks, however large a bucket is), of which only
those come out that three bounds leave open. Two hold for every linked pair, so they lose none: the sets'
sizes, and parity sketches (each shingle flips one of 4096 bits), which differ in at most as many bits as
the sets have shingles apart. For sets of `MINIMA` shingles or more, where parities fill up, the lowest
bits of 4096 minima differ no more than linked pairs' do, with five standard deviations to spare. A pair
within one component can't change the result, so it is never made; after round 3 every pair that shares a
bucket is confirmed, refuted or redundant. A round that has nothing left to look at is not begun.

No task gets a key's rows whole: a class of equal texts that is large is broadcast as one row instead of
joined, a hub's spokes are dealt to groups of some `GROUP`, and each group has the hub's set once.

With 512 bins in 64 bands of 8, a pair of similarity 0.8 shares no bucket with probability
(1 - 0.8^8)^64 = 8e-6, one of 0.9 with 1e-15; unrelated documents that share a passage (similarity
0.2) meet with probability 2e-4 a pair, so frequent passages don't fill the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, batch_rows, batches, broadcast_if_few, mix, texts
from .components import components

#: Words whose hash a Python worker remembers; it starts anew beyond that.
REMEMBERED = 200_000
#: Attempts at densification whose donors a Python worker keeps: 16, then 64, then 256.
KEPT_ATTEMPTS = 336
#: Rows of an Arrow batch: a set may take hundreds of kilobytes.
BATCH_ROWS = 500
#: Rows of a class of equal texts that is never joined by shuffling, and how many such classes there are, at most.
LARGE_CLASS, LARGE_CLASSES = 10_000, 200_000
#: Spokes that are compared with their hub in one go, on average; members of a block of round 3.
GROUP, BLOCK = 500, 1024
#: Bits of each sketch that pairs of round 3 are compared by.
SKETCH = 4096
#: Shingles of the smaller set from which minima are compared too; bits of fewer depend on each other.
MINIMA = 8192
_K = np.uint64(0x9E3779B97F4A7C15)
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("union", pa.int64())])
SKETCHES = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("odd", pa.binary()), ("low", pa.binary())])
OPEN = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class Near:
    """words: of a shingle; percent: of the union that the intersection must reach."""

    words: int = 5
    percent: int = 80
    bins: int = 512
    rows: int = 8


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
_DONORS: dict[tuple[int, int, int], np.ndarray] = {}


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct k-word shingles of the text with A-Z lower-cased;
    fewer than k words are one shingle; no words, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    if n < k:
        out = np.array([n], np.uint64) * _K
        for x in h:
            out = mix(out * _K + x)
        return out
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= _K
        out += h[i : n - k + 1 + i]
    return np.unique(mix(out))


def _donors(start: int, count: int, bins: int, empty: np.ndarray) -> np.ndarray:
    """Bins that the empty bins ask, attempt by attempt; the same for all documents. The first attempts
    are kept for all bins."""
    if start + count > KEPT_ATTEMPTS:
        return _asked(start, count, bins, empty)
    key = (start, count, bins)
    if key not in _DONORS:
        _DONORS[key] = _asked(start, count, bins, np.arange(bins))
    return _DONORS[key][:, empty]


def _asked(start: int, count: int, bins: int, empty: np.ndarray) -> np.ndarray:
    tries = np.arange(start, start + count, dtype=np.uint64)[:, None] * np.uint64(bins) + empty.astype(np.uint64)
    return (mix(tries + _K) % np.uint64(bins)).astype(np.int16)


def signature(members: np.ndarray, bins: int) -> np.ndarray:
    """One permutation, `bins` minima: the top bits of a hash choose the bin. Sorted hashes give each
    bin's minimum as its first. An empty bin takes the minimum of the first full bin in its own
    sequence of donors (optimal densification), so bins agree with the sets' similarity as probability
    however few shingles there are."""
    at = (members >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at[first]] = members[first]
    full[at[first]] = True
    empty, start, count = np.flatnonzero(~full), 0, 16
    while empty.size:
        ask = _donors(start, count, bins, empty)
        ok = full[ask]
        hit = ok.any(0)
        out[empty[hit]] = out[ask[ok.argmax(0), np.arange(empty.size)][hit]]
        empty, start = empty[~hit], start + count
        count = 4 * count if start + 4 * count <= KEPT_ATTEMPTS else max(16, (1 << 16) // max(1, empty.size))
    return out


def bands(members: np.ndarray, near: Near) -> np.ndarray:
    sig = signature(members, near.bins).reshape(-1, near.rows)
    out = np.arange(1, sig.shape[0] + 1, dtype=np.uint64) * _K
    for i in range(near.rows):
        out = mix(out + sig[:, i])
    return out.view(np.int64)


def _features(near: Near):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, hi, lo, found = [], [], [], []
            for text in texts(part.column("text")):
                members = shingles(text, near.words)
                n.append(members.size)
                key = xxhash.xxh3_128_digest(members.tobytes())
                hi.append(int.from_bytes(key[:8], "big", signed=True))
                lo.append(int.from_bytes(key[8:], "big", signed=True))
                found.append(bands(members, near) if members.size else None)
            yield batches({"doc_id": part.column("doc_id").cast(pa.int64()), "n_shingles": n, "hi": hi, "lo": lo, "bands": found}, FEATURES)

    return run


def _sets(near: Near):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id").to_pylist()
            all_texts = texts(part.column("text"))
            for at in range(0, len(ids), 256):
                sets = [shingles(t, near.words) for t in all_texts[at : at + 256]]
                yield batches({"rep": ids[at : at + 256], "n": [s.size for s in sets], "members": [s.tobytes() for s in sets]}, SETS)

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of sorted distinct hashes."""
    if not (x.size and y.size):
        return 0, x.size + y.size
    if x.size > y.size:
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == y.size] = 0
    both = int((y[at] == x).sum())
    return both, x.size + y.size - both


def _measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and group, each group's hub (b null) first. A doc_id may have several sets."""
    now, hubs = None, []
    for part in parts:
        rows = []
        for i, (hub, salt, spoke) in enumerate(zip(*(part.column(k).to_pylist() for k in ("a", "salt", "b")), strict=True)):
            own = np.frombuffer(part.column("members")[i].as_buffer(), np.uint64)
            if (hub, salt) != now:
                now, hubs = (hub, salt), []
            if spoke is None:
                hubs.append(own.copy())
            else:
                rows += [(hub, spoke, *overlap(x, own)) for x in hubs]
        cols = list(zip(*rows, strict=True)) or [[] for _ in PAIRS]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=PAIRS)


def parities(members: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit words; each member flips one. Two sets' differ in no more bits than the sets
    have members apart."""
    n = np.bincount((mix(members) >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64), minlength=SKETCH)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def _minima(members: np.ndarray) -> np.ndarray:
    return np.packbits((mix(signature(members, SKETCH)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in part.column("members")]
        yield batches({"rep": part.column("rep"), "n": part.column("n"), "odd": [parities(m).tobytes() for m in sets], "low": [_minima(m).tobytes() if m.size >= MINIMA else None for m in sets]}, SKETCHES)


@dataclass
class _Side:
    """Members of one block of a bucket, as columns."""

    rep: np.ndarray
    component: np.ndarray
    n: np.ndarray
    odd: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> _Side:
        rep, component, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        words = lambda k: np.frombuffer(b"".join(r[k] or bytes(SKETCH // 8) for r in rows), np.uint64).reshape(len(rows), -1)
        return cls(rep, component, n, words(3), words(4))


def open_pairs(x: _Side, y: _Side, same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of two blocks' members (or of one block's) that cross components and that the bounds leave
    open, the smaller doc_id first."""
    agree = (1 + percent / 100) / 2
    most = int(SKETCH * (1 - agree + 5 * (agree * (1 - agree) / SKETCH) ** 0.5))
    for i in range(x.rep.size):
        small, large = np.minimum(x.n[i], y.n), np.maximum(x.n[i], y.n)
        may = (x.component[i] != y.component) & (100 * small >= percent * large) & (x.rep[i] < y.rep if same else True)
        at = np.flatnonzero(may)
        differ = np.bitwise_count(x.odd[i] ^ y.odd[at]).sum(1, dtype=np.int64)
        at = at[(100 + percent) * differ <= (100 - percent) * (small[at] + large[at])]
        full = at[small[at] >= MINIMA]
        if full.size:
            far = full[np.bitwise_count(x.low[i] ^ y.low[full]).sum(1, dtype=np.int64) > most]
            at = at[~np.isin(at, far)]
        for j in at.tolist():
            yield min(x.rep[i], y.rep[j]), max(x.rep[i], y.rep[j])


def _opened(percent: int):
    """Rows sorted by band, i, j and own block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, second = None, [], []

        def found() -> pa.RecordBatch:
            pairs = []
            if first:
                x = _Side.of(first)
                pairs = list(open_pairs(x, _Side.of(second), False, percent) if second else open_pairs(x, x, True, percent) if now[1] == now[2] else ())
            return batches({"a": [int(a) for a, _ in pairs], "b": [int(b) for _, b in pairs]}, OPEN)

        for part in parts:
            cols = (part.column(k).to_pylist() for k in ("band", "i", "j", "own", "rep", "component", "n", "odd", "low"))
            for band, i, j, own, *row in zip(*cols, strict=True):
                if (band, i, j) != now:
                    if now is not None:
                        yield found()
                    now, first, second = (band, i, j), [], []
                (first if own == i else second).append(row)
        if now is not None:
            yield found()

    return run


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id: the smallest doc_id that links reach, itself included; kept: doc_id = component_id.
    Null and empty texts and texts without words have no shingles and link with nothing. Rows that
    share a doc_id are one document: what either text reaches, both do. A null doc_id has component_id
    null, kept true, and hands on no link. Ties don't arise. Other columns aren't read.
    """
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, near)


def _near_duplicates(docs: DataFrame, near: Near) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = scratch.keep(docs.mapInArrow(_features(near), "doc_id long, n_shingles long, hi long, lo long, bands array<long>"))

    found, large = _with_rep(features, scratch)
    members = scratch.keep(found)
    scratch.drop(features)
    #: A doc_id with several texts joins their classes; (doc_id, rep) differ from (rep, rep) only there.
    nodes = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = members.join(nodes.where("a != b").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")

    rows = members.where("bands is not null").select("rep", F.explode("bands").alias("band"))
    hubs = scratch.keep(rows.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "hub"))
    buckets = scratch.keep(rows.join(broadcast_if_few(hubs), "band").distinct())
    scratch.drop(hubs)
    wanted = broadcast_if_few(scratch.keep(buckets.select(F.col("rep").alias("doc_id")).distinct()))
    kept: list[DataFrame] = []
    sets = scratch.keep(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(near), "rep long, n long, members binary"))

    def measured(pairs: DataFrame) -> DataFrame:
        """Pairs of a hub a and b with the sizes of their sets' intersection and union. Each b's set goes to
        its hub, in groups, and a group gets its hub's set once."""
        pairs = scratch.keep(pairs)
        kept.append(pairs)
        large = scratch.keep(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("a", F.ceil(F.col("n") / GROUP).alias("salts")))
        kept.append(large)
        dealt = pairs.join(broadcast_if_few(large), "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0).cast("long")).alias("salt"), "b")
        spokes = dealt.join(sets.select(F.col("rep").alias("b"), "members"), "b").select("a", "salt", "b", "members")
        hubs = dealt.select("a", "salt").distinct().join(sets.select(F.col("rep").alias("a"), "members"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "members")
        met = spokes.union(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        return met.mapInArrow(_measured, "a long, b long, both long, union long")

    def linked(found: DataFrame) -> DataFrame:
        return found.where(100 * F.col("both") >= near.percent * F.col("union")).select("a", "b")

    def labelled(labels: DataFrame) -> DataFrame:
        return labels.select(F.col("node").alias("rep"), "component")

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with theirs."""
        own = buckets.join(labelled(labels), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = scratch.keep(own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"))
        kept.append(several)
        return scratch.keep(own.join(broadcast_if_few(several), "band", "left_semi"))

    first = buckets.where("rep != hub").groupBy("rep").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = scratch.keep(several.union(linked(measured(first))))
    labels = components(links, scratch)

    for pick in (_stars, lambda left: _open_pairs(left, sets, near, scratch)):
        left = mixed(labels)
        kept.append(left)
        if left.isEmpty():
            break
        more = scratch.keep(links.union(linked(measured(pick(left)))).distinct())
        kept.append(links)
        links, labels = more, components(more, scratch)
    for done in (buckets, sets, links, *kept):
        scratch.drop(done)

    out = _with_labels(members.select("doc_id", "n_shingles", "rep"), scratch.keep(labelled(labels)), large)
    out = out.withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_labels(rows: DataFrame, labels: DataFrame, large: DataFrame | None) -> DataFrame:
    """Rows with their rep's component, null if it has none. Few labels are broadcast; of many, those of
    the large classes are, and the other rows are joined by shuffling."""
    if labels.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(labels), "rep", "left")
    rest, out = rows.where("rep is not null"), rows.where("rep is null").withColumn("component", F.lit(None).cast("long"))
    if large is not None:  # at most LARGE_CLASSES rows
        hot = large.select("rep").join(labels, "rep", "left")
        out = out.unionByName(rest.join(F.broadcast(hot), "rep"))
        rest = rest.join(F.broadcast(large.select("rep")), "rep", "left_anti")
    return out.unionByName(rest.join(labels, "rep", "left"))


def _with_rep(features: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Each row with rep, the smallest doc_id of its class of equal shingle sets; null where there are no
    shingles or no doc_id. bands are left to the reps alone. Also the large classes, if there are any.

    Only classes of several rows are looked up. Large ones, whose number is bounded, are broadcast, so
    that their rows stay where they are; the others are broadcast if few, else joined by shuffling.
    """
    counted = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own, none = features.where(counted), features.where(~F.coalesce(counted, F.lit(False)))
    classes = scratch.keep(own.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    rows = classes.agg(F.sum("n")).first()[0] or 0
    large_from = max(LARGE_CLASS, -(-rows // LARGE_CLASSES))
    large, small = classes.where(F.col("n") >= large_from).drop("n"), scratch.keep(classes.where(F.col("n") < large_from).drop("n"))
    large = None if large.isEmpty() else large
    rest = own
    met = []
    if large is not None:  # at most LARGE_CLASSES rows
        met.append(own.join(F.broadcast(large), ["hi", "lo"]))
        rest = own.join(F.broadcast(large.drop("rep")), ["hi", "lo"], "left_anti")
    met.append(rest.join(broadcast_if_few(small), ["hi", "lo"], "left"))
    met.append(none.withColumn("rep", F.lit(None).cast("long")))
    out = met[0]
    for other in met[1:]:
        out = out.unionByName(other)
    rep = F.when(counted, F.coalesce("rep", "doc_id"))
    return out.select("doc_id", "n_shingles", rep.alias("rep"), F.when(F.col("doc_id") == rep, F.col("bands")).alias("bands")), large


def _stars(left: DataFrame) -> DataFrame:
    """Each member of the buckets with its bucket's hub."""
    return left.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def _open_pairs(left: DataFrame, sets: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """The pairs in buckets that cross components and that the bounds leave open: each bucket's members
    are dealt to blocks, and each two blocks, or one by itself, meet in a task."""
    sketches = scratch.keep(sets.join(left.select("rep").distinct(), "rep", "left_semi").mapInArrow(_sketches, "rep long, n long, odd binary, low binary"))
    blocks = left.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = left.select("band", "rep", "component").join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.select("band", "rep", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component")
    met = dealt.join(sketches, "rep").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "own")
    return met.mapInArrow(_opened(near.percent), "a long, b long").distinct()
