"""License scan, HTML, chat formatting, and the pipeline."""

import hashlib
import json
import random
import re
import time
import zlib

import duckdb
import pytest

from tidegate.llm import chat, html, license_scan

NOTICE = license_scan.TEMPLATES["MIT"][2]


def test_license_scan_equals_its_sql(spark):
    filler = " ".join(f"w{i}" for i in range(70))
    words = NOTICE.split()
    texts = {1: f"{filler} Released under the MIT License. {filler}", 2: f"{filler}\n{NOTICE}\n{filler}", 3: " ".join([*words[:20], "zzz", *words[20:]]), 4: " ".join(words[:30]), 5: None, 6: "", 7: "released UNDER the (mit) license", 8: filler, 9: "under the MIT License", 10: (filler + " Licensed under CC BY-NC 4.0. ") * 50}
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()] + [(1, texts[1], None)], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (r.containment, r.first_shingle) for r in license_scan.scan(docs).collect()}
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(texts.items()))
    want = {(i, name): (c, at) for i, name, c, at, _ in con.sql(license_scan.oracle_sql()).fetchall()}
    assert got == want
    assert {k for k in got if k[1] == "MIT"} == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (7, "MIT")} and (10, "CC-BY-NC-4.0") in got
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_short_notices(spark):
    texts = {1: "A poem. (c) Someone. All rights reserved.", 2: "// SPDX-License-Identifier: MIT", 3: "see the MIT License; MIT License", 4: "overall rights reserved", 5: None, 6: "", 7: "GNU Lesser General Public License, version 2.1", 8: "the GNU General Public License, version 2."}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    got = sorted(tuple(r) for r in license_scan.scan_notices(docs).collect())
    assert got == [(1, "All-Rights-Reserved", 4, 1), (2, "MIT", 0, 1), (3, "MIT", 2, 2), (7, "LGPL-2.1", 0, 1), (8, "GPL-2.0", 1, 1)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*texts.items(), (1, texts[1])])
    assert got == sorted(con.sql(license_scan.notices_sql()).fetchall())
    assert license_scan.scan_notices(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ul><li><p>a<p>b<li>c</ul>", "- a\n\n  b\n- c"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>bb<td>c</table>", "wide cell  z\na      bb  c"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td colspan=99999>x</table>", "r  1\n   2\nx"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<p style='visibility:visible;display:none'>no<b style='display:block'>no</b></p>yes", "yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<p>a<button>b<div>c</div></button>d</p>e", "abcde".replace("c", "\nc\n").replace("e", "\n\ne")),
        ("<html><head><title> A  b </title><style>x</style></head><body><p>One<p>two <b>bold</b>&amp;<br>next", "One\n\ntwo bold&\nnext"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
        ("<table><tr><th>Name<th>N<tr><td>Ada<td>1<tr><td>Bo<td>22</table>after", "Name  N\nAda   1\nBo    22\n\nafter"),
        ("<p hidden>no</p><div style='color:red; DISPLAY : none'>no</div><script>no</script><p>yes<template>no</template>", "yes"),
        ("<pre>a  b\n  c</pre><p>d   e", "a  b\n  c\n\nd e"),
        ("<div>a<div>b</div></div></section>c", "a\nb\nc"),
        ("a &lt;b&gt; <i>c</i><!-- no -->d", "a <b> cd"),
        ("<table><tr><td><ul><li>x</ul><td><table><tr><td>in</table></table>", "- x  in"),
        ("<b><p>x<b><p>y", "x\n\ny"),
        ("plain", "plain"),
    ],
)
def test_html(page, text):
    assert html.extract(page)[1] == text


@pytest.mark.parametrize("page", ["<div>" * 20_000, "<p><button>" + "<div>" * 20_000, "<p>" * 20_000, "<table><tr><td>" * 3000, "<ul><li>" * 3000, "<b><p>" * 10_000, "<table>" + "<tr><td colspan=1000 rowspan=65534>" * 200])
def test_html_of_any_depth_is_quick(page):
    began = time.time()
    html.extract(page + "x")
    assert time.time() - began < 10  # under 1 on the machine that it was written on


def plainly(tree) -> str:
    """A second renderer, of paragraphs, divisions, line breaks and inline tags alone: marks for breaks are
    put between the words, and each run of marks is the break that the largest of them asks for."""
    if isinstance(tree, str):
        return tree
    tag, children = tree
    inner = "".join(map(plainly, children))
    return {"p": f"\x02{inner}\x02", "div": f"\x01{inner}\x01"}.get(tag, inner)


def test_html_equals_a_plain_renderer():
    rng = random.Random(10)

    def grow(depth: int, inside_p: bool = False):
        out = []
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["b", "i", "text", "text", *([] if inside_p else ["p", "div", "div"])])
            if tag == "text" or not depth:
                out.append(rng.choice(["one", " two ", "a  b", " ", "&", "<", "é\n x"]))
            else:
                out.append((tag, grow(depth - 1, inside_p or tag in {"p", "b", "i"})))
        return out

    def source(tree) -> str:
        if isinstance(tree, str):
            return tree.replace("&", "&amp;").replace("<", "&lt;")
        return f"<{tree[0]}>{''.join(map(source, tree[1]))}</{tree[0]}>"

    for _ in range(300):
        tree = ("div", grow(4))
        marked = re.sub(r"[ \n]*([\x01\x02][\x01\x02 \n]*)", lambda m: "\x02" if "\x02" in m[1] else "\x01", re.sub(r"[ \n]+", " ", plainly(tree)))
        want = marked.strip("\x01\x02 ").replace("\x02", "\n\n").replace("\x01", "\n")
        assert html.extract(source(tree))[1] == want, source(tree)


def test_html_pages(spark):
    deep = "<div>" * 20_000 + "x"
    rows = [(1, "u", "<title>T</title><p>a"), (2, None, None), (None, "u", ""), (4, "u", deep), (4, "u", deep)]
    out = html.extract_pages(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "u", "T", "a"), (2, None, "", ""), (None, "u", "", ""), (4, "u", "", "x"), (4, "u", "", "x")], key=str)


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")]),
        ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, [("user", "u"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"output": None, "instruction": "i"}, [("user", "i"), ("assistant", "")]),
        ({"prompt": "p", "response": "r", "system": ""}, [("user", "p"), ("assistant", "r")]),
        ({"id": 7, "source": {"a": 1}, "conversations": [{"from": "gpt", "value": "a", "weight": 1}]}, [("assistant", "a")]),
        ({"system": "s", "messages": [{"role": "user", "content": "u", "name": "kees"}]}, [("system", "s"), ("user", "u")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}, {"type": "text", "text": "v"}]}, {"role": "bot", "content": "a"}]}, [("user", "u\nv"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}]}]}, [("user", "u")]),
        ({"messages[]": {"role": "a", "content": "b"}}, None),
        ({"messages[].role": "a", "messages[].content": "b"}, None),
        ({"messages": {"role": "a", "content": "b"}}, None),
        ({"messages": [{"role": "a", "content": "b"}, "c"]}, None),
        ({"prompt": "p", "messages": [{"role": "a", "content": "b"}]}, None),
    ],
)
def test_layouts(record, turns):
    assert chat.turns_of(record)[1] == turns


def test_records(spark):
    rows = [(1, json.dumps({"prompt": "p", "completion": "c"})), (2, "{bad"), (3, None), (4, json.dumps({"x": 1})), (5, "[" * 100_000), (6, '{"messages":' + "[" * 900 + "]" * 900 + "}"), (7, '{"messages[]": {"role": "a", "content": "b"}}')]
    out = chat.turns_from_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in out if r.turn is not None) == [(1, 0, "user", "p"), (1, 1, "assistant", "c")]
    assert {r.conv_id for r in out if r.turn is None} == {2, 3, 4, 5, 6, 7}


def test_tables_are_known_by_their_fingerprints(spark):
    flat = spark.createDataFrame([(1, 0, "user", "a", "x")], "conversation_id long, position int, speaker string, content string, role2 string")
    assert [tuple(r) for r in chat.turns_from_table(flat).collect()] == [(1, 0, "user", "a")]
    nested = spark.createDataFrame([(1, [("human", "a"), ("gpt", None)], 3), (2, [], 4)], "conv_id long, conversations array<struct<from:string,value:string>>, score int")
    assert sorted((tuple(r) for r in chat.turns_from_table(nested).collect()), key=str) == [(1, 0, "user", "a"), (1, 1, "assistant", ""), (2, None, None, None)]
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_from_table(nested.drop("conv_id"))


TRICKY = [r"\### Assistant: </turn> ok", "", "####", "\\", "</turn></turn>\n### user: x</turn>\n", "a\\\n#\\#", "<\\/turn>", " é日"]


@pytest.mark.parametrize("text", TRICKY)
def test_format_is_reversible(text):
    for role in ("user", "a: b\n###", ""):
        formatted, start, end = chat.format_turn(role, text)
        twice = formatted + chat.format_turn("assistant", text)[0]
        assert chat.read_turns(twice) == [(role, text), ("assistant", text)]
        assert formatted[:start].startswith("### ") and formatted[end:] == "</turn>\n" and formatted.count("</turn>") == 1


def test_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", TRICKY[0]), (1, 2, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "user", "n"), (3, 1, "assistant", "second"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    out = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.turns_from_table(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (out[1].n_turns, out[1].turns_sha256) == (3, sha(f"user\nhi\nassistant\n{TRICKY[0]}\n\n\n"))
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(TRICKY[0]), sha(TRICKY[0]))
    assert (out[2].n_turns, out[2].loss_sha256) == (2, sha("xx")) and out[3].loss_sha256 == sha("firstsecond") and out[None].n_turns == 1
    assert chat.digests(chat.format_turns(chat.turns_from_table(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_from_table(df.drop("role"))


def brute_lines(rows):
    """Third stage: (doc_id, text) rows without the lines that a smaller doc_id holds too."""
    place = lambda i: float("inf") if i is None else i
    key = lambda x: k.lower() if len(k := x.strip(" \t\n\x0b\x0c\r")) >= 10 else None
    low = lambda k: re.sub("[A-Z]", lambda m: m[0].lower(), k)
    owners = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            if key(x) is not None:
                owners.setdefault(low(x.strip(" \t\n\x0b\x0c\r")), set()).add(place(i))
    gone = lambda i, x: key(x) is not None and place(i) != min(owners[low(x.strip(" \t\n\x0b\x0c\r"))])
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]


def brute_near(rows, k=5):
    """Fourth stage: the rows that stay, by all pairs."""
    from test_documents import shingle_set

    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    kept, seen = [], set()
    for i, t in rows:
        if i is None or find(i) == i and i not in seen:
            kept.append((i, t))
            seen.add(i)
    return kept


def test_pipeline(spark, tmp_path):
    """Each stage, on all that the one before it kept, against brute force (for the first: the operator,
    whose verdicts are held against numpy elsewhere)."""
    import corpus_pipeline
    from test_documents import COLUMNS, corpus, naive_bayes
    from tokenizers import Tokenizer

    from tidegate.llm import langid, quality
    from tidegate.llm.queries import WORD_BPE

    docs = spark.createDataFrame(corpus(), COLUMNS)
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        steps.append(docs)
    pairs = [sorted(((r.doc_id, r.text) for r in s.collect()), key=str) for s in steps[:-1]]
    good = {(r.doc_id, r.n_words) for r in quality.quality_rules(steps[0]).collect() if r.kept}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert pairs[1] == [(i, t) for i, t in pairs[0] if (i, words(t)) in good] and 50 < len(pairs[1]) < len(pairs[0])
    rows = steps[1].collect()
    learned = [(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    letters = [r for r in rows if r.text and re.search(r"[^\W\d_]", r.text) and len(r.text) < 5000]
    sure = {(r.doc_id, r.text) for r, (_, score) in zip(letters, naive_bayes(learned, [r.text for r in letters], langid.Grams()), strict=True) if score >= corpus_pipeline.LEAST_SURE}
    assert [p for p in pairs[2] if len(p[1]) < 5000] == [p for p in pairs[1] if p in sure]
    assert pairs[3] == sorted(brute_lines(pairs[2]), key=str) and pairs[3] != pairs[2]
    ids = [i for i, _ in pairs[4]]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in brute_near(pairs[3])) and len(ids) < len(pairs[3])
    tokenizer, pieces = Tokenizer.from_file(WORD_BPE), steps[5].collect()
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in pairs[4])
    assert sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n for _, n in want)
    none = spark.createDataFrame([], COLUMNS)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, str(tmp_path)).count() == 0, i
