"""From raw documents to packed sequences: five stages, each calling one operator of tidegate.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs, of any names and types, and
an empty table gives no rows at any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import langid, line_dedup, near_dup, packing, quality
from tidegate.llm.common import Scratch, broadcast_if_few, table
from tidegate.llm.queries import WORD_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Predictions less sure than this are rejected, as are texts without a letter.
LEAST_SURE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that share doc_id and text stand or fall together. A null
    or empty text has no words, so it goes; null languages and sources are groups like others."""
    scratch = Scratch(spark)
    rules = quality.Quality()
    verdicts = quality.judged(scratch.keep(quality.base_statistics(docs, rules)), rules, scratch)
    bad = scratch.keep(verdicts.where("not kept").select(F.col("doc_id").alias("__tidegate_id"), F.col("text_hash").alias("__tidegate_hash")).distinct())
    same = (F.xxhash64(docs["text"]) == bad["__tidegate_hash"]) & docs["doc_id"].cast("long").eqNullSafe(bad["__tidegate_id"])
    return docs.join(broadcast_if_few(bad), same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model is sure of. Null, empty and letterless texts go; a null
    lang or doc_id only means that nothing is learned from the row. Of languages that are equally likely
    the first by name counts. Repeated rows are predicted alike. Where nothing could be learned, all texts
    with a letter stay."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, "__tidegate_lang", "__tidegate_sure")
    if not model.languages:  # nothing was learned, so nothing is rejected for its language
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return found.where((F.col("__tidegate_lang") != "und") & (F.col("__tidegate_sure") >= LEAST_SURE)).drop("__tidegate_lang", "__tidegate_sure")


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id also holds; n_chars follows. A null
    text stays null, an empty one empty. Rows that share a doc_id are one document, so they keep what they
    share; a null doc_id comes after all others."""
    return line_dedup.dedup_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id; one row of each id. Texts
    without words are linked with nothing, rows without a doc_id all stay."""
    found = near_dup.near_duplicates(docs, near_dup.Near(words=5))
    gone = Scratch(spark).keep(found.where("not kept").select(F.col("doc_id").alias("__tidegate_id")).distinct())
    left = docs.join(broadcast_if_few(gone), docs["doc_id"].cast("long") == gone["__tidegate_id"], "left_anti")
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__tidegate_id")).count().where("count > 1").select("__tidegate_id")
    if several.isEmpty():
        return left
    same = left["doc_id"] == several["__tidegate_id"]
    return left.join(several, same, "left_anti").union(left.join(several, same, "left_semi").dropDuplicates(["doc_id"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces. A null or empty text is its end mark alone; repeated rows, and rows without a
    doc_id, are packed each for itself."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup_),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: No stage but the third can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
