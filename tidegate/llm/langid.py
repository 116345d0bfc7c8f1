"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered by Spark from a bounded sample of labelled documents, stratified by language; every
language is learned. The smoothed log-probabilities are a matrix with a row a bucket and a column a
language, broadcast in blocks of languages. A batch of texts is one sparse matrix (a row a text, an entry
an n-gram that occurs), which numpy multiplies by the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Scratch, batches, importable, sliced, texts

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


@dataclass(frozen=True)
class Grams:
    """buckets: rows of the matrix, a power of two; sizes: of the n-grams; sample: labelled rows of a
    language that are learned from, at most, in expectation; languages: columns of a block of the matrix;
    chars: code points whose n-grams are scored at a time."""

    buckets: int = 1 << 15
    sizes: tuple[int, ...] = (1, 2, 3)
    sample: int = 10_000
    languages: int = 64
    smoothing: float = 0.5
    chars: int = 1 << 19


@dataclass
class Block:
    """Some languages' columns."""

    languages: list[str]
    weights: np.ndarray  # log-probabilities: languages x (buckets, and one of zeros that counts nothing)
    prior: np.ndarray


@dataclass
class Model:
    blocks: list[Block]
    grams: Grams = field(default_factory=Grams)

    @property
    def languages(self) -> list[str]:
        return [x for b in self.blocks for x in b.languages]


class Sparse:
    """The n-grams of texts as rows of a sparse matrix: for each size of n-gram an array of buckets, in
    which row i begins at starts[i]. Rows are the non-empty pieces of the texts, owner[i] is a row's
    text. A place where no n-gram of that size begins has the bucket that counts nothing."""

    def __init__(self, pieces: list[tuple[int, np.ndarray, int]], grams: Grams):
        """pieces: (text, its code points, how many of them n-grams begin at)."""
        self.owner = np.array([i for i, _, _ in pieces], np.int64)
        sizes = np.array([p.size for _, p, _ in pieces], np.int64)
        begins = np.array([n for _, _, n in pieces], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        points = np.concatenate([p for _, p, _ in pieces])
        within = np.arange(points.size) - np.repeat(self.starts, sizes)
        self.buckets, self.counts = [], np.zeros(len(pieces), np.int64)
        for n in grams.sizes:
            last = np.minimum(begins, sizes - n + 1)
            h = np.full(max(0, points.size - n + 1), n * 0x27D4EB2F % 2**32, np.uint32)
            for i in range(n):
                h = (h ^ points[i : i + h.size]) * np.uint32(_MULTIPLIERS[i % 3])
                h ^= h >> np.uint32(15)
            out = np.full(points.size, grams.buckets, np.int32)
            out[: h.size] = h & np.uint32(grams.buckets - 1)
            out[within >= np.repeat(last, sizes)] = grams.buckets
            self.buckets.append(out)
            self.counts += np.maximum(last, 0)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The product with the block's matrix: rows x languages."""
        out = np.zeros((self.owner.size, weights.shape[0]))
        for b in self.buckets:
            for k, column in enumerate(weights):
                out[:, k] += np.add.reduceat(column[b], self.starts, dtype=np.float64)
        return out


def sparse_batches(many: Sequence[str], grams: Grams) -> Iterator[Sparse]:
    """The texts' n-grams, lower-cased, some texts or parts of a long one at a time."""
    most, held, size = max(grams.sizes) - 1, [], 0
    for i, text in enumerate(many):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, points.size, grams.chars):
            own = points[at : at + grams.chars + most]
            held.append((i, own, min(grams.chars, points.size - at)))
            size += own.size
            if size >= grams.chars:
                yield Sparse(held, grams)
                held, size = [], 0
    if held:
        yield Sparse(held, grams)


def _counts(grams: Grams):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names, all_texts = part.column("lang").to_pylist(), texts(part.column("text"))
            for lang in dict.fromkeys(names):
                row = np.zeros(grams.buckets + 1, np.int64)
                for s in sparse_batches([t for x, t in zip(names, all_texts, strict=True) if x == lang], grams):
                    for b in s.buckets:
                        row += np.bincount(b, minlength=grams.buckets + 1)
                at = np.flatnonzero(row[: grams.buckets])
                yield batches({"lang": [lang] * at.size, "bucket": at, "n": row[at]}, COUNTS)

    return run


def train(labelled: DataFrame, grams: Grams = Grams()) -> Model:
    """labelled: doc_id, text, lang. Every lang value is learned. Rows with null text or lang are left
    out. No rows give a model without languages."""
    scratch = Scratch(importable(labelled.sparkSession))
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    totals = scratch.keep(rows.groupBy("lang").agg(F.count("*").alias("total")))
    languages = {r["lang"]: r["total"] for r in totals.orderBy("lang").collect()}  # a row a language
    if not languages:
        return Model([], grams)
    few = len(languages) <= 100_000
    drawn = rows.join(F.broadcast(totals) if few else totals, "lang")
    chosen = drawn.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < F.lit(float(grams.sample << 30)) / F.col("total")).select("lang", "text")
    found = chosen.mapInArrow(_counts(grams), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = scratch.keep(found) if len(languages) > grams.languages else found
    blocks, names, every = [], list(languages), sum(languages.values())
    for at in range(0, len(names), grams.languages):
        own = names[at : at + grams.languages]
        index = pa.array(own, pa.string())
        part = found if len(names) <= grams.languages else found.where(F.col("lang").between(own[0], own[-1]))
        got = part.toArrow()  # at most a block's languages x buckets
        counts = np.full((len(own), grams.buckets), grams.smoothing)
        place = pa.compute.index_in(got.column("lang").combine_chunks(), index).to_numpy(zero_copy_only=False).astype(np.int64)
        counts[place, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
        weights = np.zeros((len(own), grams.buckets + 1))
        weights[:, :-1] = np.log(counts / counts.sum(1, keepdims=True))
        blocks.append(Block(own, weights, np.log(np.array([languages[x] for x in own], float) / every)))
    scratch.close()
    return Model(blocks, grams)


def _scored(block: Broadcast, grams: Grams, schema: pa.Schema):
    """Adds to each text's best language so far (its name, its log-posterior, the logarithm of the sum of
    all languages' tempered shares, its own tempered one) those of a block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            own, many = block.value, part.column("__text").to_pylist()
            many = [t if t and _LETTER.search(t) else "" for t in many]
            total, n = np.zeros((len(many), len(own.languages))), np.zeros(len(many))
            for s in sparse_batches(many, grams):
                np.add.at(total, s.owner, s.times(own.weights))
                np.add.at(n, s.owner, s.counts)
            full = total + own.prior
            at = full.argmax(1)
            best = full[np.arange(len(many)), at]
            tempered = total / np.sqrt(np.maximum(n, 1))[:, None]
            top = tempered.max(1)
            spread = top + np.log(np.exp(tempered - top[:, None]).sum(1))
            mine = tempered[np.arange(len(many)), at]
            names = [own.languages[k] for k in at]
            if part.column("__best").null_count < part.num_rows:
                before, b_best, b_spread, b_mine = (part.column(c) for c in ("__lang", "__best", "__spread", "__mine"))
                b_best, b_spread, b_mine = (x.to_numpy(zero_copy_only=False) for x in (b_best, b_spread, b_mine))
                keep = b_best >= best
                names = [x if k else y for x, k, y in zip(before.to_pylist(), keep, names, strict=True)]
                best, mine, spread = np.where(keep, b_best, best), np.where(keep, b_mine, mine), np.logaddexp(b_spread, spread)
            names = [x if t else None for x, t in zip(names, many, strict=True)]
            added = [pa.array(names, pa.string()), *[pa.array(x, pa.float64()) for x in (best, spread, mine)]]
            yield pa.RecordBatch.from_arrays([*part.columns[:-4], *added], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from. A null doc_id is in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def predict(docs: DataFrame, model: Model, label: str = "lang_pred", sure: str = "score") -> DataFrame:
    """docs with the two columns added. The text alone decides.

    sure: the language's share of the posterior, tempered by the root of the number of n-grams, as
    n-grams aren't independent. und and 0 if text is null, has no letter, or nothing was learned. Each
    block of languages is one pass over the texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    state = [StructField("__lang", StringType()), *[StructField(n, DoubleType()) for n in ("__best", "__spread", "__mine")]]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("__text"))
    schema = StructType([*renamed.schema, *state])
    out = renamed.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in state])
    for block in model.blocks:
        held = importable(docs.sparkSession).sparkContext.broadcast(block)  # buckets x languages, both bounded by Grams
        out = out.mapInArrow(_scored(held, model.grams, to_arrow_schema(schema)), schema)
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    known = F.col("__lang").isNotNull()
    return out.select(*columns, F.coalesce("__lang", F.lit("und")).alias(label), F.when(known, F.exp(F.col("__mine") - F.col("__spread"))).otherwise(0.0).alias(sure))


def identify(docs: DataFrame, grams: Grams = Grams()) -> DataFrame:
    """One row a row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    It learns from the rows outside the held-out fold that have a text and a lang. Null, empty and
    letterless texts get und and 0.0, and so does all if nothing could be learned. Repeated rows are
    predicted alike. An empty table gives no rows. Other columns aren't read.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), grams)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text")
