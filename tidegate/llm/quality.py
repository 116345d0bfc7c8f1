"""Quality rules: base statistics, and robust multivariate outliers by language and source.

All of it is DataFrame expressions. The statistics of a text are computed in its row; nothing is
exploded. Groups are (language, source); small ones are pooled by language, then all together. For each
group the minimum covariance determinant is approached by concentration steps from a deterministic
start (median and median absolute deviation): the distances' median chooses the central half of the
texts, whose mean and covariance give the next distances. Copies of one text count once in it, however
many; so an estimate holds while under half of a group's different texts are outliers. A step is two
aggregates over the table of statistics with map-side combining (sums; a quantile sketch), so a group
that holds a third of all rows is no hot key, and the 4 x 4 inverses are expressions over one row a group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Groups whose estimates are broadcast to the rows, at most; a row of estimates takes some 300 bytes.
BROADCAST_GROUPS = 20_000


@dataclass(frozen=True)
class Quality:
    """least_words, most_repeated (percent): the base rule. central: the share of texts that a group's
    estimate is made of; it bears outliers up to the rest. least_group: different texts that a group needs. tail: of the chi-squared distribution
    that is rejected. steps: at most. spread: the least standard deviation of each feature."""

    least_words: int = 20
    most_repeated: int = 30
    window: int = 8
    central: float = 0.5
    least_group: int = 100
    tail: float = 1e-6
    steps: int = 8
    spread: tuple[float, ...] = (0.06, 0.15, 0.12, 0.12)


def statistics(text: Column, window: int = 8) -> dict[str, list[tuple[str, Column]]]:
    """Expressions in layers; each layer uses columns of the ones before."""
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    hashes = F.when(F.col("__n") >= window, F.transform(F.sequence(F.lit(1), F.col("__n") - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, window))))
    in_order = F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.array_sort(F.transform("__hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    twice = lambda x, i: F.when((x["h"] == F.get("__order", i - 1)["h"]) | (x["h"] == F.get("__order", i + 1)["h"]), x["p"])
    at = F.array_sort(F.filter(F.transform("__order", twice), lambda x: x.isNotNull()))
    covered = F.aggregate(F.transform("__at", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("__at", i + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    return {
        "text": [("__words", words), ("__lines", lines), ("n_symbols", F.regexp_count(text, F.lit(_SYMBOL)).cast("long"))],
        "words": [("__n", F.size("__words")), ("word_chars", F.char_length(F.array_join("__words", "")).cast("long")), ("__n_lines", F.size("__lines")), ("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))],
        "hashes": [("__hashes", hashes)],
        "order": [("__order", in_order)],
        "at": [("__at", at)],
        "end": [("n_words", F.col("__n").cast("long")), ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))],
    }


def base_statistics(docs: DataFrame, quality: Quality = Quality()) -> DataFrame:
    """doc_id, lang, source, text_hash, the base statistics, the number of lines with a word, base_failed."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("__text"))
    drop = {"text": ["__text"], "words": ["__lines"], "hashes": ["__words"], "order": ["__hashes"], "at": ["__order"], "end": ["__at"]}
    for layer, columns in statistics(F.col("__text"), quality.window).items():
        out = out.select("*", *[c.alias(name) for name, c in columns]).drop(*drop[layer])
    failed = (F.col("n_words") < quality.least_words) | (100 * F.col("n_repeat_words") > quality.most_repeated * F.col("n_words"))
    return out.select("doc_id", "lang", "source", "text_hash", *BASE, F.col("__n_lines").cast("long").alias("n_lines"), failed.alias("base_failed"))


def features() -> list[Column]:
    """Transformed statistics: word length, symbols, repeated lines, repeated words. Added constants draw
    short texts, whose rates scatter, to the middle."""
    n, c = F.col("n_words"), F.col("word_chars")
    return [F.log((c + 250) / (n + 50)), F.log1p(100 * F.col("n_symbols") / (c + 300)), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)), F.sqrt(F.col("n_repeat_words") / (n + 100))]


# --- chi-squared, for an even number of degrees of freedom ----------------------------------------
def chi2_cdf(x: float, d: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))


def chi2_quantile(tail: float, d: int) -> float:
    """The x that exceeds all but the share tail."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(d // 2)) > tail else (low, mid)
    return low


# --- estimates ------------------------------------------------------------------------------------
def _with(rows: DataFrame, small: DataFrame, groups: int) -> DataFrame:
    """Rows with their group's estimates: broadcast if the groups are few, else a join that AQE splits."""
    return rows.join(F.broadcast(small) if groups <= BROADCAST_GROUPS else small, "g", "left")


def _distance(d: int) -> Column:
    diff = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + diff[i] * diff[j] * F.col(f"v{min(i, j)}{max(i, j)}")
    return total


def _inverse(table: DataFrame, d: int) -> DataFrame:
    """Columns s_ij (a covariance) -> v_ij (its inverse) and logdet, by Cholesky's factors."""
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"s{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(d):  # the factor's inverse, by columns
        for i in range(j, d):
            if i == j:
                table = table.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}"))
            else:
                total = F.lit(0.0)
                for k in range(j, i):
                    total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                table = table.withColumn(f"w{i}{j}", -total / F.col(f"l{i}{i}"))
    for i in range(d):
        for j in range(i, d):
            total = F.lit(0.0)
            for k in range(j, d):
                total = total + F.col(f"w{k}{i}") * F.col(f"w{k}{j}")
            table = table.withColumn(f"v{i}{j}", total)
    logdet = F.lit(0.0)
    for i in range(d):
        logdet = logdet + 2 * F.log(f"l{i}{i}")
    return table.withColumn("logdet", logdet)


def _grouped(rows: DataFrame, quality: Quality, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with g, the group that their estimate comes from; null where even all rows are too few. Also
    the stored tables that they are read with."""
    good = rows.where("not base_failed").select("lang", "source", "text_hash").distinct()
    sizes = scratch.keep(good.groupBy("lang", "source").agg(F.count("*").alias("n")))
    pooled = F.sum(F.when(F.col("n") < quality.least_group, F.col("n"))).over(Window.partitionBy("lang"))
    name = F.when(F.col("n") >= quality.least_group, F.to_json(F.struct("lang", "source"))).when(F.col("pooled") >= quality.least_group, F.to_json(F.struct("lang"))).otherwise(F.lit("*"))
    named = sizes.withColumn("pooled", pooled).select("lang", "source", name.alias("g"), "n")
    named = scratch.keep(named)
    rest = named.where("g = '*'").agg(F.sum("n")).first()[0] or 0
    names = named.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *([F.col("g")] if rest >= quality.least_group else [F.when(F.col("g") != "*", F.col("g")).alias("g")]))
    few = names.count() <= BROADCAST_GROUPS
    met = rows.join(F.broadcast(names) if few else names, rows["lang"].eqNullSafe(names["__lang"]) & rows["source"].eqNullSafe(names["__source"]), "left")
    return met.drop("__lang", "__source"), [sizes, named]


def judged(stats: DataFrame, quality: Quality, scratch: Scratch) -> DataFrame:
    """The statistics with kept and distance (Mahalanobis, squared; null where there is no estimate)."""
    d = len(quality.spread)
    grouped, used = _grouped(stats.select("*", *[f.alias(f"f{i}") for i, f in enumerate(features())]), quality, scratch)
    rows = scratch.keep(grouped)
    for done in used:
        scratch.drop(done)
    texts = rows.where("not base_failed and g is not null").groupBy("g", "text_hash").agg(*[F.min(f"f{i}").alias(f"f{i}") for i in range(d)])
    inside = scratch.keep(texts.drop("text_hash"))
    middle = scratch.keep(inside.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(f"f{i}", 0.5, 1000).alias(f"m{i}") for i in range(d)]).where(F.col("n") >= quality.least_group).drop("n"))
    groups = middle.count()
    away = _with(inside, middle, groups).groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(d)], *[F.percentile_approx(F.abs(F.col(f"f{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"q{i}") for i in range(d)]).where("m0 is not null")
    now = scratch.keep(away.select("g", *[f"m{i}" for i in range(d)], *[(1 / (F.pow(1.4826 * F.col(f"q{i}"), 2) + s * s) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, s in enumerate(quality.spread) for j in range(i, d)], F.lit(float("inf")).alias("logdet")))
    last = now  # the stored table of the last step
    inner = chi2_quantile(1 - quality.central, d)
    scale = quality.central / chi2_cdf(inner, d + 2)  # makes the central rows' covariance that of all
    for _ in range(quality.steps if groups else 0):
        near = _with(inside, now, groups).withColumn("d2", _distance(d))
        bound = scratch.keep(near.groupBy("g").agg(F.percentile_approx("d2", quality.central, 2000).alias("bound")))
        chosen = _with(near, bound, groups).where("d2 <= bound")
        sums = [F.count("*").alias("n"), F.first("logdet").alias("before")]
        sums += [F.avg(F.col(f"f{i}")).alias(f"m{i}") for i in range(d)]
        sums += [F.covar_pop(f"f{i}", f"f{j}").alias(f"c{i}{j}") for i in range(d) for j in range(i, d)]
        spread = [(F.col(f"c{i}{j}") * scale + (quality.spread[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i in range(d) for j in range(i, d)]
        after = _inverse(chosen.groupBy("g").agg(*sums).select("g", "before", *[f"m{i}" for i in range(d)], *spread), d)
        kept = scratch.keep(after.select("g", "before", "logdet", *[f"m{i}" for i in range(d)], *[f"v{i}{j}" for i in range(d) for j in range(i, d)]))
        for done in (bound, last):
            scratch.drop(done)
        moved = kept.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        last, now = kept, kept.drop("before")
        if moved is not None and abs(moved) < 1e-3:
            break
    for done in (inside, middle):
        scratch.drop(done)
    cutoff = chi2_quantile(quality.tail, d)
    out = _with(rows, now, groups).withColumn("distance", _distance(d))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select("doc_id", "lang", "source", "text_hash", *BASE, "base_failed", kept.alias("kept"), "distance")


def quality_rules(docs: DataFrame, quality: Quality = Quality()) -> DataFrame:
    """One row a row of docs (doc_id, text, lang, source): doc_id, the base statistics, base_failed,
    kept, distance.

    A null text reads as the empty text: no words, so base_failed. Null languages and sources are
    groups like others. Copies of a text count once in a group's estimate and are judged each. Rows of
    groups with too few different texts for an estimate, even pooled, are kept unless base_failed. An empty table gives no rows. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    return judged(scratch.keep(base_statistics(docs, quality)), quality, scratch).drop("lang", "source", "text_hash")
