"""License scans: MinHash bands over overlapping text windows retrieve templates, and exact shingle
containment verifies them.

A text's shingles are 5 of its tokens (runs of a-z and 0-9, lower-cased). Templates are classed by size
W, the power of two that is at least their number m of shingles; a class has windows of W + max(1, W/4)
shingles that begin at every max(1, W/4)-th, so one window holds any whole template. Where 0.8 of a
template stands, that window's similarity to it is over 0.29, and of 32 bands of one row one agrees with
probability 1 - 0.71^32 > 0.9999. A window that agrees on a band holds the very shingle that gives the
template its minimum there, so bands are worked out for the windows about such shingles alone (32 a
template at most) and no other window could be retrieved. All is DataFrame expressions in the document's
row, and a join with the templates' bands, broadcast while they are few.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BANDS, PERCENT = 5, 32, 80
#: Bands of templates that are broadcast, at most; each comes with its template's shingles.
BROADCAST_BANDS = 50_000
_TOKEN = "[a-z0-9]+"

#: Notices and opening passages of public licences, as they are commonly written.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, int, list[str]]]:
    """(licence, number, class, shingles as token strings) of each template; those under WORDS tokens
    are refused."""
    out = []
    for name, versions in templates.items():
        for i, text in enumerate(versions):
            own = tokens(text)
            grams = list(dict.fromkeys(" ".join(own[k : k + WORDS]) for k in range(len(own) - WORDS + 1)))
            if not grams:
                raise ValueError(f"template {name} {i} has under {WORDS} words")
            size = 1
            while size < len(grams):
                size *= 2
            out.append((name, i, size, grams))
    return out


def _bands(members: Column) -> Column:
    """The window's minima under BANDS hash functions, one a band."""
    def least(k: int) -> Column:
        return F.array_min(F.transform(members, lambda x: F.xxhash64(x, F.lit(k))))

    minima = [least(k) for k in range(BANDS)]
    return F.array(*[F.struct(F.lit(k).alias("band"), m.alias("low")) for k, m in enumerate(minima)])


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row a document and licence found in docs (doc_id, text): doc_id, license, containment (of
    100: the best window's share of a template's shingles), first_shingle (where the first such window
    begins, counted in shingles), n_windows (places where such windows begin).

    Windows of `percent` or more count. Null, empty and short texts have no shingles and no row. Rows
    that share a doc_id are one document. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = template_rows(templates)
    source = spark.createDataFrame([(name, i, size, grams) for name, i, size, grams in rows], "license string, version int, size int, grams array<string>")
    known = source.withColumn("shingles", F.transform("grams", lambda g: F.xxhash64(F.split(g, " ")))).drop("grams")
    known = spark.createDataFrame(known.collect(), known.schema)  # as many rows as templates
    # The shingles that give templates their minima: 32 a template at most.
    minima = known.select(F.explode(F.array_distinct(F.array(*[F.array_min(F.transform("shingles", lambda x, k=k: F.struct(F.xxhash64(x, F.lit(k)).alias("low"), x.alias("x"))))["x"] for k in range(BANDS)]))).alias("x")).distinct()
    marks = sorted(r[0] for r in minima.collect())
    retrieve = known.select("license", "version", "size", "shingles", F.explode(_bands(F.col("shingles"))).alias("b")).select("license", "version", "size", "shingles", "b.band", "b.low")

    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({_TOKEN})"), F.lit(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    shingles = F.transform(F.sequence(F.lit(1), F.size("words") - (WORDS - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WORDS)))
    # The row's number is not deterministic to the optimizer, so no later filter is moved below and makes
    # it cut the text anew for each shingle.
    hashed = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(F.size("words") >= WORDS, shingles).alias("h"))
    hits = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i).isin(marks))
    found = hashed.select("doc_id", "row", "h", F.when(F.col("h").isNotNull(), hits).alias("hits")).where(F.size("hits") > 0)
    sizes = sorted({size for _, _, size, _ in rows})
    starts = F.concat(*[_starts(F.col("hits"), size) for size in sizes])
    windows = found.select("doc_id", "row", "h", F.explode(starts).alias("w")).select("doc_id", "row", "w.size", "w.start", F.slice("h", F.col("w.start") + 1, F.col("w.size") + F.greatest(F.lit(1), F.floor(F.col("w.size") / 4).cast("int"))).alias("members"))
    met = windows.select("*", F.explode(_bands(F.col("members"))).alias("b")).select("doc_id", "row", "size", "start", "members", F.col("b.band").alias("band"), F.col("b.low").alias("low"))
    few = len(rows) * BANDS <= BROADCAST_BANDS
    met = met.join(F.broadcast(retrieve) if few else retrieve, ["size", "band", "low"])
    share = F.floor(100 * F.size(F.array_intersect("shingles", "members")) / F.size("shingles")).cast("int")
    good = met.select("doc_id", "row", "license", "start", share.alias("containment")).where(F.col("containment") >= percent)
    return good.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_shingle"), F.countDistinct("row", "start").alias("n_windows"))


def _starts(hits: Column, size: int) -> Column:
    """The class's windows that hold a hit: its size, and where they begin."""
    numbers = F.array_distinct(F.flatten(F.transform(hits, lambda i: _covering(i, size))))
    return F.transform(numbers, lambda w: F.struct(F.lit(size).alias("size"), (w * max(1, size // 4)).alias("start")))


def _covering(i: Column, size: int) -> Column:
    """Numbers of the class's windows that hold shingle i."""
    step = max(1, size // 4)
    first = F.greatest(F.lit(0), F.floor((i - (size + step) + 1 + step - 1) / step).cast("int"))
    return F.sequence(first, F.floor(i / step).cast("int"))


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same in SQL, without MinHash: every window of each class against every template."""
    values = ", ".join(f"('{name}', {i}, {size}, '{g}')" for name, i, size, grams in template_rows(templates) for g in grams)
    return f"""
WITH t(license, version, size, g) AS (VALUES {values}),
m AS (SELECT license, version, count(*) AS m FROM t GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - {WORDS - 1})) AS i, w FROM d WHERE len(w) >= {WORDS}),
h AS (SELECT DISTINCT s.doc_id, s.i, t.license, t.version, t.size, greatest(1, t.size // 4) AS step, t.g FROM s JOIN t ON array_to_string(s.w[s.i + 1:s.i + {WORDS}], ' ') = t.g),
w AS (SELECT *, unnest(range(greatest(0, CAST(ceil((i - size - step + 1) / step) AS BIGINT)), i // step + 1)) * step AS start FROM h),
c AS (SELECT doc_id, license, start, version, floor(100 * count(DISTINCT g) / m)::INT AS containment FROM w JOIN m USING (license, version) GROUP BY doc_id, license, start, version, size, m)
SELECT doc_id, license, max(containment) AS containment, min(start)::BIGINT AS first_shingle, count(DISTINCT start) AS n_windows FROM c WHERE containment >= {percent} GROUP BY doc_id, license
"""


# --- notices: whole token sequences of any length --------------------------------------------------
_SPDX = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2.0"], "GPL-3.0": ["GPL-3.0"], "LGPL-2.1": ["LGPL-2.1"], "LGPL-3.0": ["LGPL-3.0"], "AGPL-3.0": ["AGPL-3.0"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "ISC": ["ISC"], "MPL-2.0": ["MPL-2.0"], "CC0-1.0": ["CC0-1.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"]}
_PUBLISHED = "General Public License as published by the Free Software Foundation; either version"
#: Notices that are too short for shingles, or that differ from another licence's in a word or two.
NOTICES: dict[str, list[str]] = {name: [f"SPDX-License-Identifier: {i}" for i in ids] for name, ids in _SPDX.items()}
NOTICES["All-Rights-Reserved"] = ["All rights reserved."]
for _name, _texts in {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", f"GNU {_PUBLISHED} 2 of the License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", f"GNU {_PUBLISHED} 3 of the License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", f"GNU Lesser {_PUBLISHED} 2.1 of the License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", f"GNU Lesser {_PUBLISHED} 3 of the License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", f"GNU Affero {_PUBLISHED} 3 of the License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}.items():
    NOTICES[_name] = [*NOTICES[_name], *_texts]


def notice_rows(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, list[str]]]:
    """(licence, tokens) of each notice; those without a token are refused."""
    out = [(name, tokens(text)) for name, texts in notices.items() for text in texts]
    if bad := [name for name, own in out if not own]:
        raise ValueError(f"a notice of {bad[0]} has no word")
    return out


def scan_all(docs: DataFrame) -> DataFrame:
    """Both scans: one row a document, licence and way of finding it: doc_id, license, found_by (passage
    or notice), containment (100 for a notice), first (the shingle or token where the first place
    begins), n_places."""
    passages = scan(docs).select("doc_id", "license", F.lit("passage").alias("found_by"), "containment", F.col("first_shingle").alias("first"), F.col("n_windows").alias("n_places"))
    notices = scan_notices(docs).select("doc_id", "license", F.lit("notice").alias("found_by"), F.lit(100).alias("containment"), F.col("first_token").alias("first"), "n_places")
    return passages.union(notices)


def scan_all_sql() -> str:
    """The same in SQL."""
    return f"""SELECT doc_id, license, 'passage' AS found_by, containment, first_shingle AS first, n_windows AS n_places FROM ({oracle_sql()})
UNION ALL SELECT doc_id, license, 'notice', 100, first_token, n_places FROM ({notices_sql()})"""


def scan_notices(docs: DataFrame, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """One row a document and licence whose notice stands in docs (doc_id, text) token for token: doc_id,
    license, first_token (where the first notice begins, counted in tokens), n_places (tokens where one
    or more of the licence's notices begin).

    Notices are of any length. Null and empty texts have no row. Rows that share a doc_id are one
    document: its places are those of all its distinct texts. An empty table gives no rows.
    """
    rows = notice_rows(notices)
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({_TOKEN})"), F.lit(1))
    # One search of the raw text settles which few rows are cut into tokens.
    any_of = "|".join("[^a-z0-9]+".join(own) for own in dict.fromkeys(tuple(own) for _, own in rows))
    texts = docs.where(F.lower("text").rlike(f"(?<![a-z0-9])(?:{any_of})(?![a-z0-9])"))
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), words.alias("words"))

    def begins(own: list[str]) -> Column:
        """Numbers of the tokens where the notice begins."""
        first = F.sequence(F.lit(0), F.size("words") - len(own))
        at = F.filter(first, lambda i: (F.get("words", i) == own[0]) & (F.slice("words", i + 1, len(own)) == F.array(*map(F.lit, own))))
        return F.when(F.size("words") >= len(own), at).otherwise(F.array().cast("array<int>"))

    names = list(dict.fromkeys(name for name, _ in rows))
    found = [F.struct(F.lit(name).alias("license"), F.array_distinct(F.concat(*[begins(own) for n, own in rows if n == name])).alias("at")) for name in names]
    each = texts.select("doc_id", "h", F.explode(F.filter(F.array(*found), lambda x: F.size(x["at"]) > 0)).alias("x")).select("doc_id", "h", "x.license", F.explode("x.at").alias("at"))
    return each.groupBy("doc_id", "license").agg(F.min("at").cast("long").alias("first_token"), F.countDistinct("h", "at").alias("n_places"))


def notices_sql(notices: dict[str, list[str]] = NOTICES) -> str:
    """The same in SQL: the tokens at every place against every notice."""
    values = ", ".join(f"('{name}', {own})" for name, own in notice_rows(notices))
    return f"""
WITH t(license, own) AS (VALUES {values}),
d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM documents),
p AS (SELECT doc_id, text, w, unnest(range(0, len(w))) AS i FROM d),
f AS (SELECT DISTINCT doc_id, text, license, i FROM p JOIN t ON w[i + 1] = own[1] AND w[i + 1:i + len(own)] = own)
SELECT doc_id, license, min(i)::BIGINT AS first_token, count(*) AS n_places FROM f GROUP BY doc_id, license
"""
