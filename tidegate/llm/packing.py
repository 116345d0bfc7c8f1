"""Packing documents into token sequences: cutting stock by column generation.

1. Documents are tokenized; those of a sequence's length or more are cut into full sequences and a
remainder. 2. The remainders' lengths, rounded up by one part in `FINE` at most, give a histogram of a
few hundred classes; that is all the driver sees. Lengths up to 2 * FINE tokens are exact. 3. A linear
program over patterns (how many pieces of each class share a sequence) is solved by a revised simplex. It
starts from patterns that the knapsack gives for prices near the sizes; its columns come from an unbounded
knapsack by dynamic programming over the dual prices, several from each run, and it ends when its dual
bound proves that no program is better by a sequence, or by one in a thousand. Patterns are used their rounded-down number of times; the
few pieces left are packed largest first. 4. A piece's rank in its class (its Spark
partition's offset, plus its place there) says which slot of which sequence it fills: no shuffle by
class, so a length that a third of all documents have is no hot key. Offsets are running sums within a
sequence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_rows, batches, texts
from .words import bare_words, byte_letters

#: Classes of lengths are as wide as the largest power of two up to length / FINE.
FINE = 128
#: The share of sequences by which a plan may exceed the linear program's dual bound.
GAP = 1e-3
#: Columns that one run of the knapsack gives, at most; pivots after which the basis is inverted anew.
COLUMNS, ANEW = 24, 500
#: Runs of the knapsack in which the program must gain something.
PATIENCE = 50
#: Rows of an Arrow batch: their texts are held as words.
BATCH_ROWS = 2000
#: Distinct words whose ids a Python worker remembers; it starts anew beyond that.
REMEMBERED = 400_000
#: The letters and numbers up to U+024F, and the pattern that cuts words made of these code points.
_LETTER, _NUMBER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_OTHER = re.compile("[^\x00-\u024f]|[\x09-\x0d\x1c-\x20\x85\xa0]")
_LETTERS = dict(enumerate(byte_letters()))
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("part", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long, ids binary"
_PLACED = pa.schema([*[PIECES.field(i) for i in range(5)], ("sequence_id", pa.int64()), ("slot", pa.int64()), PIECES.field("ids")])


# --- tokens ---------------------------------------------------------------------------------------
class _Numbers(dict):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordIds:
    """ids of texts by way of a table of the distinct words seen, each encoded once while it is held.

    Words of letters, digits and signs up to U+024F are cut by the tokenizer's own pattern, written out
    for these code points, and go straight to its model; composition changes none of them, and lower
    case works letter by letter. All others go through the whole tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.at, self.flat, self.starts = _Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def word(self, word: str) -> list[int]:
        low = word.lower()
        if _OTHER.search(low) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        core = low[:-1] if low[-1:] in (".", ",") else low
        out: list[int] = []
        for t in (core, low[-1]) if core is not low and core.isalpha() else (low,) if core.isalpha() else _PIECES.findall(low):
            if not (t.isascii() and t.isprintable()):
                t = t.encode().decode("latin-1").translate(_LETTERS)
            out += [x.id for x in self.model.tokenize(t)]
        return out

    def _learn(self) -> None:
        known = self.starts.size - 1
        found = [self.word(w) for w in islice(self.at, known, None)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + self.flat.size
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.uint32)))
        self.starts = np.concatenate((self.starts, ends))

    def _forget(self) -> None:
        """All but the words learned first, among which are the frequent ones."""
        self.at = _Numbers(islice(self.at.items(), REMEMBERED // 3))
        self.starts = self.starts[: len(self.at) + 1].copy()
        self.flat = self.flat[: self.starts[-1]].copy()

    def encode(self, many: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; about a million characters of texts at a time."""
        at = 0
        while at < len(many):
            numbers, size = [], 0
            while at < len(many) and size < 1_000_000:
                words = bare_words(many[at])
                numbers.append(np.fromiter(map(self.at.__getitem__, words), np.int32, len(words)))
                size += len(many[at])
                at += 1
            self._learn()
            sizes = np.diff(self.starts)
            for idx in numbers:
                own = sizes[idx]
                ends = np.cumsum(own)
                yield self.flat[np.repeat(self.starts[idx] - ends + own, own) + np.arange(int(ends[-1]) if idx.size else 0)]
            if len(self.at) > REMEMBERED:
                self._forget()


_WORKER: dict[int, WordIds] = {}


def rounded(length: np.ndarray, capacity: int) -> np.ndarray:
    """Lengths rounded up to their classes."""
    width = 1 << np.maximum(0, np.frexp(length // FINE)[1] - 1)
    return np.minimum(-(-length // width) * width, capacity)


def _cut(spec: Broadcast, capacity: int, end_id: int, keep_ids: bool):
    classes = rounded(np.arange(capacity + 1), capacity).tolist()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        key = hash(spec.value)
        if key not in _WORKER:
            _WORKER[key] = WordIds(spec.value)
        coder = _WORKER[key]
        ranks = [0] * (capacity + 1)
        for part in parts:
            rows: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts(part.column("text"))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, ids.size, capacity):
                    own = ids[start : start + capacity].tobytes()
                    length = len(own) // 4
                    kind = classes[length]
                    rows.append((doc, start, length, zlib.crc32(own), ids.size, kind, part_id, ranks[kind], own if keep_ids else None))
                    ranks[kind] += 1
            cols = list(zip(*rows, strict=True)) or [[] for _ in PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)

    return run


# --- the plan -------------------------------------------------------------------------------------
def best_patterns(prices: np.ndarray, sizes: np.ndarray, capacity: int, most: int = 1) -> tuple[float, list[np.ndarray]]:
    """The unbounded knapsack by dynamic programming: the worth of the best filling, and the counts of it
    and of the next best with another piece first. sizes ascend."""
    worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best, pick = worth[c - 1], -1
        if fits[c]:
            own = worth[c - sizes[: fits[c]]] + prices[: fits[c]]
            k = int(own.argmax())
            if own[k] > best + 1e-12:
                best, pick = own[k], k
        worth[c], choice[c] = best, pick
    first = worth[capacity - sizes] + prices
    found = []
    for k in np.argsort(-first, kind="stable")[:most]:
        counts, c = np.zeros(sizes.size, np.int64), capacity - int(sizes[k])
        counts[k] = 1
        while c > 0:
            if choice[c] >= 0:
                counts[choice[c]] += 1
                c -= int(sizes[choice[c]])
            else:
                c -= 1
        if not any((counts == x).all() for x in found):
            found.append(counts)
    return float(worth[capacity]), found


def first_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first solution: patterns, a row each, the number of times each is used (of parts of a sequence,
    too), and the size that each uses up. The knapsack prices sizes a little more than in proportion, so
    the large ones come first and the small ones fill; a pattern is used until one of its sizes is used
    up, so there are no more patterns than sizes. Where pieces fit together at all, their sum is that of
    the volume but for some parts in ten thousand."""
    rest, prices = demand.astype(float).copy(), sizes**1.02
    patterns, times, ends = [], [], []
    while (left := np.flatnonzero(rest > 0)).size:
        counts = np.zeros(sizes.size, np.int64)
        counts[left] = best_patterns(prices[left], sizes[left], capacity)[1][0]
        used = np.flatnonzero(counts)
        each = rest[used] / counts[used]
        first = int(used[each.argmin()])
        rest[used] -= each.min() * counts[used]
        rest[(rest < 1e-9 * demand) | (np.arange(sizes.size) == first)] = 0
        patterns.append(counts)
        times.append(each.min())
        ends.append(first)
    return np.array(patterns), np.array(times), np.array(ends)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss and Jordan with row pivots. Plain array arithmetic: a linear algebra library
    brings threads of its own, which don't get on with a process that forks and runs a JVM."""
    m = len(matrix)
    left, out = matrix.astype(float).copy(), np.eye(m)
    for k in range(m):
        p = k + int(np.abs(left[k:, k]).argmax())
        for x in (left, out):
            x[[k, p]] = x[[p, k]]
            x[k] /= left[k, k] if x is out else 1
        left[k] /= left[k, k]
        factor = left[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        left[rows] -= factor[rows, None] * left[k]
        out[rows] -= factor[rows, None] * out[k]
    return out


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(1)


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (a row each), how often the linear program uses them, each size's demand met, and a lower
    bound of any program's sum. Column generation ends when the sum is within a sequence, or the share
    gap, of that bound: of the dual bound, the demand's price over the worth of the best pattern, and of
    the volume. It also ends when `PATIENCE` runs of the knapsack gain under a part in ten thousand: by
    then the program is as good as rounding errors let it be."""
    m, volume = sizes.size, float((sizes * demand).sum()) / capacity
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0), 0.0
    rng = np.random.default_rng(0)
    target = demand * (1 + 1e-6 * rng.random(m)) + 1e-3 * rng.random(m)  # no ties, so no cycles
    start, times, ends = first_columns(sizes, target, capacity)
    bound, enough = volume, lambda x: x - bound <= max(1.0, gap * bound)
    if enough(times.sum()):
        return start, times, bound
    # The basis: a first pattern for the size that it uses up, else as many pieces of one size as fit.
    patterns = np.diag((capacity // sizes).astype(float))
    patterns[:, ends] = start.T
    used = np.zeros(m)
    used[ends] = times
    inverse, pivots, runs, before = inverted(patterns), 0, 0, np.inf
    while not enough(used.sum()):
        if runs % PATIENCE == 0:
            if used.sum() > before * (1 - 1e-4):
                break
            before = used.sum()
        runs += 1
        prices = inverse.sum(0)
        worth, found = best_patterns(prices, sizes, capacity, COLUMNS)
        bound = max(bound, float((prices * demand).sum()) / worth)
        if worth <= 1 + 1e-9:
            break
        for counts in found:
            enters = _times(inverse, counts)
            if enters.sum() <= 1 + 1e-9:
                continue
            rise = np.full(m, np.inf)
            up = enters > 1e-9
            rise[up] = used[up] / enters[up]
            out = int(rise.argmin())
            used = np.maximum(used - rise[out] * enters, 0)
            used[out] = rise[out]
            row = inverse[out] / enters[out]
            inverse -= enters[:, None] * row
            inverse[out] = row
            patterns[:, out] = counts
            pivots += 1
            if pivots % ANEW == 0:
                inverse = inverted(patterns)
                used = np.maximum(_times(inverse, target), 0)
    met = _times(patterns, used)
    if used.sum() >= times.sum() or (np.abs(met - target) > 1e-3 * target + 1).any():
        return start, times, bound
    return patterns.T.astype(np.int64), used, bound


@dataclass
class Plan:
    """For each class, the ranks at which its slots in each pattern begin. sequences: in all patterns."""

    starts: dict[int, np.ndarray]
    pattern: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    base: np.ndarray
    sequences: int

    def place(self, kind: np.ndarray, rank: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
        """full: the class of pieces that fill a sequence by themselves."""
        sequence, slot = self.sequences + rank, np.zeros(rank.size, np.int64)
        for k in np.unique(kind[kind != full]):
            own = np.flatnonzero(kind == k)
            at = np.searchsorted(self.starts[k], rank[own], "right") - 1
            past, each = rank[own] - self.starts[k][at], self.each[k][at]
            sequence[own] = self.base[self.pattern[k][at]] + past // each
            slot[own] = (k << 32) + past % each
        return sequence, slot


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """histogram: pieces by class, which is the length they are taken for. The driver's work and memory
    depend on the number of classes alone."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    demand = np.array([histogram[k] for k in sizes.tolist()], np.int64)
    patterns, used, _ = cutting_stock(sizes, demand, capacity)
    times = np.floor(used + 1e-6).astype(np.int64)
    while (over := patterns.T @ times - demand).max(initial=0) > 0:  # rounding errors of the program
        times[np.flatnonzero(patterns[:, int(over.argmax())] * times)[0]] -= 1
    rest = demand - patterns.T @ times
    extra: list[np.ndarray] = []
    while rest.sum():  # a few pieces a class: largest first, then whatever fills best
        row, room = np.zeros(sizes.size, np.int64), capacity
        while (fit := np.flatnonzero((rest > 0) & (sizes <= room))).size:
            k = fit[-1]
            n = min(rest[k], room // sizes[k])
            row[k] += n
            rest[k] -= n
            room -= n * sizes[k]
        extra.append(row)
    patterns, times = np.concatenate([patterns[times > 0], np.array(extra, np.int64).reshape(len(extra), sizes.size)]), np.concatenate([times[times > 0], np.ones(len(extra), np.int64)])
    base = np.concatenate(([0], np.cumsum(times)))
    out = Plan({}, {}, {}, base, int(base[-1]))
    for i, k in enumerate(sizes):
        has = np.flatnonzero(patterns[:, i])
        taken = patterns[has, i] * times[has]
        out.starts[int(k)], out.pattern[int(k)], out.each[int(k)] = np.cumsum(taken) - taken, has, patterns[has, i]
    return out


def _place(made: Plan, full: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kind, rank = part.column("class").to_numpy().astype(np.int64), part.column("rank").to_numpy() + part.column("before").to_numpy()
            sequence, slot = made.place(kind, rank, full)
            yield batches({f.name: part.column(f.name) for f in _PLACED if f.name in part.schema.names} | {"sequence_id": sequence, "slot": slot}, _PLACED)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    keep_ids the piece's ids (little-endian unsigned 32-bit integers).

    Each row of docs (doc_id, text) gives the tokenizer's ids of its text, then end_id; a null or empty
    text gives end_id alone. Rows that repeat, or share a doc_id, or have none, are packed each for
    itself. An empty table gives no pieces. Other columns aren't read. Only documents of more than
    `capacity` ids are cut.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary: its size is fixed
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(spec, capacity, end_id, keep_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long, ids binary")
    with batch_rows(spark, BATCH_ROWS):
        pieces = scratch.keep(pieces)
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).drop("n")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(capacity, None)
    placed = pieces.join(before, ["class", "part"]).mapInArrow(_place(plan(histogram, capacity), capacity), PLACED)
    own = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(own), F.lit(0).cast("long")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
