"""Byte-level BPE over a whole table by way of its distinct words.

1. Documents are split into words (see words.py) in blocks of about `BLOCK` characters, and each block's
distinct words are dealt by hash to shards. 2. A shard holds the table of its distinct words and encodes
each once; an answer has the ids of a block's words in the block's order. 3. Each block meets its
answers: a word's position in the block's list is the join key, so what is shuffled is each text once
(compressed) and each distinct word of a block once, never a row for each word of a text. 4. Decoding
joins ids to pieces: the vocabulary's table of pieces is of fixed size and is at hand in every task.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, importable, texts
from .words import byte_letters, spaced_words

BLOCK = 16_000_000
#: Bytes of text whose blocks meet their words' ids in one task, on average.
TASK = 64_000_000
WORDS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("words", pa.binary())])
MEET = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


# --- blobs ----------------------------------------------------------------------------------------
def _least(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as all of them need, after that width."""
    width = next(w for w in (1, 2, 4) if not values.size or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    return np.frombuffer(raw, f"<u{raw[at]}", count, at + 1), at + 1 + raw[at] * count


def _packed(sizes: np.ndarray, body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.int64(sizes.size).tobytes() + _least(sizes) + body)


def _unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, end = _numbers(raw, 8, int(np.frombuffer(raw, np.int64, 1)[0]))
    return sizes.astype(np.int64), raw[end:]


def pack_words(words: list[str]) -> bytes:
    own = [w.encode("utf-8", "surrogatepass") for w in words]
    return _packed(np.fromiter(map(len, own), np.int64, len(own)), b"".join(own))


def unpack_words(blob: bytes) -> list[str]:
    sizes, body = _unpacked(blob)
    ends = np.cumsum(sizes).tolist()
    return [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)]


# --- the library's side ---------------------------------------------------------------------------
class Coder:
    """The tokenizer, and the bytes of each id's piece."""

    _held: dict[int, Coder] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        back = {c: b for b, c in enumerate(byte_letters())}
        self.pieces = []
        for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1):
            token = self.tokenizer.id_to_token(i) or ""
            self.pieces.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())

    @classmethod
    def of(cls, spec: Broadcast) -> Coder:
        key = hash(spec.value)
        if key not in cls._held:
            cls._held = {key: cls(spec.value)}
        return cls._held[key]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of each word, one after the other."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(words), 5_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + 5_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((x for own in found for x in own), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(ids)


def gathered(idx: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat's stretches idx, one after the other."""
    own = sizes[idx]
    ends = np.cumsum(own)
    return flat[np.repeat(starts[idx] - ends + own, own) + np.arange(int(ends[-1]) if idx.size else 0)]


# --- stages ---------------------------------------------------------------------------------------
def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(block, doc_ids, texts) of a task's rows. A block's number is a hash of what it holds, so it is
    the same whenever and wherever the block is read; blocks that are equal share their answers."""

    def numbered(ids: list, many: list[str]) -> tuple[int, list, list[str]]:
        h = xxhash.xxh3_64()
        for doc, text in zip(ids, many, strict=True):
            h.update(f"{doc} {len(text)} ")
            h.update(text.encode("utf-8", "surrogatepass"))
        return h.intdigest() - 2**63, ids, many

    ids, many, size = [], [], 0
    for part in parts:
        for doc, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
            ids.append(doc)
            many.append(text)
            size += len(text)
            if size >= BLOCK:
                yield numbered(ids, many)
                ids, many, size = [], [], 0
    if ids:
        yield numbered(ids, many)


class _Numbers(dict):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _shards(words: Iterable[str], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers by shard, then first use; and how many of them each shard has."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % shards for w in words), np.int64)
    return np.argsort(own, kind="stable"), np.bincount(own, minlength=shards)


def _words(shards: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, many in _blocks(parts):
            seen: dict[str, None] = {}
            for t in many:
                seen.update(dict.fromkeys(spaced_words(t)))
            words = list(seen)
            order, counts = _shards(words, shards)
            ends, has = np.cumsum(counts), np.flatnonzero(counts).tolist()
            yield batches({"block": [block] * len(has), "shard": has, "words": [pack_words([words[i] for i in order[ends[k] - counts[k] : ends[k]]]) for k in has]}, WORDS)

    return run


def _encoded(spec: Broadcast):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard; one shard's table at a time."""
        coder, now, table = Coder.of(spec), None, {}
        for part in parts:
            for i in range(part.num_rows):
                shard, block = part.column("shard")[i].as_py(), part.column("block")[i].as_py()
                if shard != now:
                    now, table = shard, {}
                    sizes, flat, room = np.zeros(0, np.int64), np.zeros(0, np.uint32), 0
                    starts = np.zeros(0, np.int64)
                words = unpack_words(part.column("words")[i].as_py())
                if new := [w for w in words if w not in table]:
                    s, f = coder.encode(new)
                    table.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    starts, sizes, flat = np.concatenate((starts, flat.size + np.cumsum(s) - s)), np.concatenate((sizes, s)), np.concatenate((flat, f))
                idx = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                yield batches({"block": [block], "shard": [shard], "blob": [_packed(sizes[idx], _least(gathered(idx, starts, sizes, flat)))]}, MEET)

    return run


def _kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents as one blob, after its answers (shard 2^31 - 1)."""
    for block, ids, many in _blocks(parts):
        sink = pa.BufferOutputStream()
        rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array(many, pa.large_string())], names=["doc_id", "text"])
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            out.write_batch(rows)
        yield batches({"block": [block], "shard": [2**31 - 1], "blob": [sink.getvalue().to_pybytes()]}, MEET)


def _joined(spec: Broadcast, shards: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, answers, now = Coder.of(spec).pieces, {}, None
        for part in parts:
            for i in range(part.num_rows):
                block, shard, blob = (part.column(k)[i].as_py() for k in ("block", "shard", "blob"))
                if block != now:
                    now, answers = block, {}
                if shard != 2**31 - 1:
                    answers[shard] = _unpacked(blob)
                    continue
                rows = pa.ipc.open_stream(blob).read_next_batch()
                many = rows.column("text").to_pylist()
                numbers = _Numbers()
                split = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in map(spaced_words, many)]
                order, counts = _shards(numbers, shards)
                place = np.empty(order.size, np.int64)
                place[order] = np.arange(order.size)
                if [(k, n) for k, n in enumerate(counts.tolist()) if n] != [(k, s.size) for k, (s, _) in answers.items()]:
                    raise RuntimeError("documents came in other blocks when read again: write them to a table first")
                sizes = np.concatenate([np.zeros(0, np.int64), *[s for s, _ in answers.values()]])
                flat = np.concatenate([np.zeros(0, np.uint32), *[_numbers(f, 0, int(s.sum()))[0].astype(np.uint32) for s, f in answers.values()]])
                starts = np.cumsum(sizes) - sizes
                ids, decoded = [], []
                for words in split:
                    own = gathered(place[words], starts, sizes, flat)
                    ids.append(own.astype("<u4").tobytes())
                    decoded.append(b"".join(map(pieces.__getitem__, own.tolist())).decode("utf-8", "replace"))
                    if len(ids) == 1000:
                        yield batches({"doc_id": rows.column("doc_id").slice(0, 1000), "ids": ids, "decoded": decoded}, OUT)
                        rows, ids, decoded = rows.slice(1000), [], []
                yield batches({"doc_id": rows.column("doc_id"), "ids": ids, "decoded": decoded}, OUT)

    return run


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, ids (little-endian unsigned 32-bit integers, as the
    tokenizer encodes the whole text without special tokens added), decoded (those ids' text).

    A null text reads as the empty text, with no ids. Rows that repeat, or share a doc_id, or have
    none, are encoded each for itself. An empty table gives no rows. Other columns aren't read. docs
    must come in the same partitions when read again, as a scan does; anything else raises an error
    that says so. A shard's table of distinct words is in memory. The shards grow as the root of the
    counted characters, so that neither a shard's words nor the rows of all blocks' words by shard (some
    1000 characters each) grow out of proportion; what the blocks' tasks read is bounded by `TASK`.
    """
    spark = importable(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary: its size is fixed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, tasks = max(2 * parts, math.isqrt(chars // BLOCK)), max(parts, -(-chars // TASK))
    words = docs.mapInArrow(_words(shards), "block long, shard int, words binary")
    answers = words.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_encoded(spec), "block long, shard int, blob binary")
    meet = answers.union(docs.mapInArrow(_kept, "block long, shard int, blob binary")).repartition(tasks, "block").sortWithinPartitions("block", "shard")
    return meet.mapInArrow(_joined(spec, shards), "doc_id long, ids binary, decoded string")
