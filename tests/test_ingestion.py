"""What files may hold and be called, and where they may lie: nothing is lost, nothing leaks."""

import json
import time
import tracemalloc
from contextlib import contextmanager
from pathlib import Path

import duckdb
import pytest
import yaml
from avro_files import encode
from test_run import accepted, contract, counts_of

from tidegate import api
from tidegate.sinks import tables
from tidegate.sources.json import read_json_array
from tidegate.sources.lines import AT, FILE_ORD
from tidegate.sources.xml import Elements, read_xml, rows_of
from tidegate.storage import Files

ODD = ["a b", "a%20b", "a+b", "c[1]", "k{a,b}", "st*r", "q?y", "é#ü", "plain", "x'y\"z"]
TWO = [{"name": "id", "type": "string"}, {"name": "name", "type": "string"}]


def bodies(spark, tmp: Path, fmt: str) -> bytes:
    """A file of two rows."""
    if fmt in ("parquet", "orc"):
        at = tmp / f"one_{fmt}"
        spark.createDataFrame([("1", "x"), ("2", "y")], "id string, name string").coalesce(1).write.mode("overwrite").format(fmt).save(str(at))
        return next(at.glob("part-*")).read_bytes()
    rows = [{"id": "1", "name": "x"}, {"id": "2", "name": "y"}]
    texts = {"csv": "id;name\n1;x\n2;y\n", "tsv": "id\tname\n1\tx\n2\ty\n", "fixed": "1x\n2y\n", "json": json.dumps(rows), "ndjson": "\n".join(map(json.dumps, rows)), "xml": "<r><row><id>1</id><name>x</name></row><row><id>2</id><name>y</name></row></r>"}
    return encode([("id", "string"), ("name", "string")], rows, codec="snappy") if fmt == "avro" else texts[fmt].encode()


ENDINGS = {"fixed": "txt", "ndjson": "json"}


@pytest.mark.parametrize("fmt", ["csv", "tsv", "fixed", "json", "ndjson", "xml", "parquet", "orc", "avro"])
def test_names_of_all_kinds(spark, tmp_path, fmt):
    body = bodies(spark, tmp_path, fmt)
    columns = [{**c, "width": 1} for c in TWO] if fmt == "fixed" else TWO
    options = {"xml": {"row_tag": "row"}, "ndjson": {"json_mode": "ndjson"}}.get(fmt)
    more = {"options": options} if options else {}
    c = contract(tmp_path, fmt="json" if fmt == "ndjson" else fmt, columns=columns, files={f"{n}.{ENDINGS.get(fmt, fmt)}": body for n in ODD}, **more)
    e = api.run(spark, c).entities[0]
    assert (e.status, e.rows, e.accepted) == ("success", 2 * len(ODD), 2 * len(ODD)), e
    assert all(f.rows == 2 for f in e.files)


@pytest.mark.parametrize("mode", ["archive", "file"])
def test_odd_names_are_moved_and_marked_only_when_read(spark, tmp_path, mode):
    more = {"archive": {"path": "done"}} if mode == "archive" else {}
    c = contract(tmp_path, files={"a%20b.csv": "id;name\n1;x\n2;y\n"}, incremental_mode=mode)
    raw = yaml.safe_load(Path(c).read_text())
    raw["entities"][0]["sink"].update(more)
    Path(c).write_text(yaml.safe_dump(raw))
    assert counts_of(spark, c) == (2, 0)
    assert [p.read_text() for p in (tmp_path / "done").glob("a%20b__run-*.csv")] == (["id;name\n1;x\n2;y\n"] if mode == "archive" else [])
    assert (tmp_path / "in/a%20b.csv").exists() == (mode == "file")


def test_files_that_spark_passes_over_end_the_run(spark, tmp_path):
    e = api.run(spark, contract(tmp_path, files={"_a.csv": "id;name\n1;x\n", "b.csv": "id;name\n1;x\n"})).entities[0]
    assert e.status == "failed" and "_a.csv" in e.notes[0]


def test_quoted_line_breaks_and_ragged_rows(spark, tmp_path):
    files = {"a.csv": 'id;name\n1;"x\ny"\n2;"a "";"" b"\n', "b.csv": "id;name\n3\n4;p;q\n5;r\n", "c.csv": 'id;name\n6;"; one; two"\n', "d.csv": 'id;"na\nme"\n7;z\n'}
    e = api.run(spark, contract(tmp_path, files=files)).entities[0]
    assert (e.rows, e.accepted, e.rejected) == (7, 6, 1), e
    assert accepted(spark, tmp_path) == sorted([("1", "x\ny"), ("2", 'a ";" b'), ("3", None), ("5", "r"), ("6", "; one; two"), ("7", None)], key=str)
    row = spark.read.options(header=True, escape='"').csv(str(tmp_path / "out/rejected")).collect()[0]
    assert (row["id"], row["__dq_row_index"]) == ("4", "1") and json.loads(row["__dq_errors"])[0]["rule"] == "schema_error"
    assert counts_of(spark, contract(tmp_path, files=files, cast_mode="coerce")) == (7, 0)


def test_empty_cells_without_null_values(spark, tmp_path):
    api.run(spark, contract(tmp_path, files={"a.csv": "id;name\n1;\n2;NA\n3\n"}, options={"null_values": ["NA"]}))
    assert accepted(spark, tmp_path) == [("1", ""), ("2", None), ("3", None)]


@pytest.mark.parametrize(("fmt", "body", "error"), [("json", b'[{"id": 1, "name": "Ada Secret"}', None), ("json", b'{"name": "Ada Secret"}', "json_shape_error"), ("parquet", b"Ada Secret is no parquet", "parquet_read_error"), ("orc", b"Ada Secret", "orc_read_error"), ("xlsx", b"Ada Secret", "xlsx_parse_error"), ("avro", b"Ada Secret", "avro_parse_error"), ("csv", b"", "csv_header_error")])
@pytest.mark.parametrize("masked", [True, False])
def test_unreadable_files_are_rejected_and_leak_nothing(spark, tmp_path, fmt, body, error, masked):
    pii = {"pii": {"columns": [{"name": "name", "strategy": "hash"}]}} if masked else {}
    events = []
    out = api.run(spark, contract(tmp_path, fmt=fmt, files={f"a.{fmt}": body}, **pii), observer=events.append).entities[0]
    assert out.status == "rejected" and out.files[0].status == "rejected", out
    assert (error or "json_parse_error") in out.files[0].error
    kept = [p.read_bytes() for p in tmp_path.glob("out/rejected/*") if p.is_file()]
    assert kept == ([] if masked else [body])
    assert any(e.get("code") == "pii_file_error_drop" for e in events) == masked


def test_uris_go_through_hadoop(spark, tmp_path):
    """Listing, globs, ledger, raw copies and archive on file: URIs, as on any other file system."""
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/deep.csv").write_text("id;name\n9;z\n")
    c = contract(tmp_path, files={"a b.csv": "id;name\n1;x\n", "b%.csv": "id;name\n2;y\n", "c.csv": "", "d.txt": "no"}, incremental_mode="file", write_mode="append")
    raw = yaml.safe_load(Path(c).read_text())
    e = raw["entities"][0]
    e["source"]["path"] = f"file://{tmp_path}/in"
    e["sink"]["accepted"]["path"], e["sink"]["rejected"]["path"] = f"file://{tmp_path}/out/accepted", f"file://{tmp_path}/out/rejected"
    e["sink"]["archive"] = {"path": f"file://{tmp_path}/done"}
    Path(c).write_text(yaml.safe_dump(raw))
    done = api.run(spark, c, run_id="r").entities[0]
    assert (done.status, done.rows, done.accepted) == ("rejected", 2, 2), done
    assert [Path(f.path).name for f in done.files] == ["a b.csv", "b%.csv", "c.csv"]
    assert {p.name.split("__")[0] for p in (tmp_path / "done").glob("*.csv")} == {"a b", "b%", "c"}
    assert (tmp_path / "out/rejected/c.csv").exists() and not (tmp_path / "in/a b.csv").exists()
    assert len(json.loads((tmp_path / "in/.tidegate/state/e/state.json").read_text())["files"]) == 3
    e["source"]["path"] = f"file://{tmp_path}/in/*/deep*.csv"
    Path(c).write_text(yaml.safe_dump(raw))
    assert counts_of(spark, c) == (1, 0)
    files = Files(spark)
    (tmp_path / "in/sub/deep.csv").write_text("id;name\n9;z\n")
    assert [f.stem for f in files.find(f"file://{tmp_path}/in", (".csv",), recursive=True)] == ["deep"]
    assert not files.create(f"file://{tmp_path}/in/sub/deep.csv") and files.create(f"file://{tmp_path}/lock")
    with pytest.raises(ValueError, match="literal bucket"):
        files.find("s3a://b*/x", (".csv",))


def test_many_small_files(spark, tmp_path):
    began = time.time()
    assert counts_of(spark, contract(tmp_path, files={f"f{i:04}.csv": f"id;name\n{i};x\n" for i in range(1000)})) == (1000, 0)
    assert time.time() - began < 200  # some 10 on the machine that it was written on


def test_error_report_has_a_folder_a_file(spark, tmp_path):
    columns = [{"name": "id", "type": "integer"}, {"name": "name", "type": "string"}]
    out = api.run(spark, contract(tmp_path, columns=columns, severity="warn", files={"a.csv": "id;name\nx;1\n2;2\ny;3\n", "b.csv": "id;name\n1;1\n", "c.csv": "id;name\nz;1\n"})).entities[0]
    rows = spark.read.json(out.errors_path).collect()
    assert sorted((r["file"], r["row_index"]) for r in rows) == [("0_a", 0), ("0_a", 2), ("2_c", 0)]
    assert out.status == "success_with_warnings" and out.warnings == 3 and out.phases["write"] >= 0


def test_unique_figures_tell_batch_from_target(spark, tmp_path):
    columns = [{"name": "id", "type": "string", "unique": True}, {"name": "name", "type": "string"}]
    c = contract(tmp_path, columns=columns, write_mode="append", files={"a.csv": "id;name\n1;a\n2;b\n"})
    api.run(spark, c)
    (tmp_path / "in/a.csv").write_text("id;name\n2;b\n3;c\n3;d\n2;e\n")
    events = []
    e = api.run(spark, c, observer=events.append).entities[0]
    (u,) = e.unique
    assert (u["duplicates"], u["batch_duplicates"], u["target_duplicates"], u["affected_keys"], u["effect"]) == (3, 1, 2, 2, "reject_rows")
    assert spark.read.options(header=True).csv(str(tmp_path / "out/rejected")).count() == 3
    assert [x["event"] for x in events] == ["run_started", "entity_started", "file_started", "file_finished", "entity_finished", "run_finished"]
    assert events[-1]["rows"] == 4 and events[-1]["summary"].endswith("run.summary.json")


@pytest.mark.parametrize("sink", ["duckdb", "versioned", "parquet"])
def test_appends_add(spark, tmp_path, sink):
    target = {"format": sink, "path": "out/t.duckdb" if sink == "duckdb" else "out/t", **({"duckdb": {"table": "t"}} if sink == "duckdb" else {})}
    (tmp_path / "out").mkdir()
    columns = [{"name": "id", "type": "string", "unique": True}, {"name": "name", "type": "string"}]
    run = lambda body: counts_of(spark, contract(tmp_path, columns=columns, accepted=target, write_mode="append", files={"a.csv": body}))
    assert run("id;name\n1;a\n2;b\n") == (2, 0) and run("id;name\n2;x\n3;c\n") == (1, 1) and run("id;name\n3;x\n") == (0, 1)
    if sink == "duckdb":
        with duckdb.connect(str(tmp_path / "out/t.duckdb")) as con:
            assert sorted(con.execute("from t").fetchall()) == [("1", "a"), ("2", "b"), ("3", "c")]
    elif sink == "versioned":
        pointer = json.loads((tmp_path / "out/t/_current").read_text())
        assert pointer["folders"] == ["v1", "v2"]
        assert spark.read.parquet(*[str(tmp_path / "out/t" / f) for f in pointer["folders"]]).count() == 3
    else:
        assert len(accepted(spark, tmp_path, "out/t")) == 3


def test_connectors_that_are_missing_say_so(spark, tmp_path):
    e = api.run(spark, contract(tmp_path, accepted={"format": "delta", "path": "out/d"}, files={"a.csv": "id;name\n1;x\n"})).entities[0]
    assert e.status == "failed" and "the delta connector is not on the classpath" in e.notes[0]


def test_partitioned_sizes_and_small_files(spark, tmp_path):
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    c = contract(tmp_path, accepted={"partition_by": ["name"], "options": {"max_size_per_file": 40}}, files={"a.csv": "id;name\n" + "".join(f"{i:010};{'xy'[i % 2]}\n" for i in range(40))})
    out = api.run(spark, c).entities[0].output
    assert out["files"] >= 10 and out["bytes"] > 0 and out["small_files"] == 0
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held  # a run releases what it persists


def small_splits(spark, size: int):
    """Splits of so many bytes for the reads inside."""
    return conf_set(spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"})


@contextmanager
def conf_set(spark, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_json_arrays_are_cut_anywhere(spark, tmp_path, size):
    odd = ["{", "}{", 'a"{\\', "[{", "é{ü", "", '\\{"', "x\n{\r", "]", "],[", None]
    rows = [{"id": str(i), "name": odd[i % len(odd)], "more": {"{": [odd[-2 - i % 5], {"n": i}]}} for i in range(40)]
    texts = [json.dumps(rows), json.dumps(rows[:3], indent=2, ensure_ascii=False) + "\n\n", "﻿" + json.dumps(rows[3:5]), "[]", "", "[{}", json.dumps(rows[:2]) + json.dumps(rows[2:3]), '[{"id": "1"},, {"id": "2"}]', '[{"id": "1"} {"id": "2"}]', '[{"id": "1"}, 5]', '{"id": "1"}', "{bad", '[{"id": "1", "id": "2"}]', "[{}]{"]
    paths = [(i, str(tmp_path / f"{i}.json")) for i in range(len(texts))]
    for (_, p), text in zip(paths, texts, strict=True):
        Path(p).write_bytes(text.encode())
    with small_splits(spark, size):
        found = read_json_array(spark, paths, {"id": "id", "name": "name", "n": "more.{[1].n"}).collect()
    bad = {r[FILE_ORD]: r["__error"] for r in found if r["__error"]}
    assert bad == {4: "json_parse_error", 5: "json_parse_error", 6: "json_parse_error", 7: "json_parse_error", 8: "json_parse_error", 9: "json_shape_error", 10: "json_shape_error", 11: "json_parse_error", 12: "json_parse_error", 13: "json_parse_error"}
    got = {i: [(r["raw_id"], r["raw_name"], r["raw_n"]) for r in sorted((r for r in found if r[FILE_ORD] == i), key=lambda r: r[AT])] for i in range(4)}
    want = [(r["id"], r["name"], str(r["more"]["{"][1]["n"])) for r in rows]
    assert got == {0: want, 1: want[:3], 2: want[3:5], 3: []}


def test_a_json_array_takes_time_by_its_length(spark, tmp_path):
    """Each row once looked at the whole file: 40,000 rows took many minutes."""
    rows = [{"id": str(i), "name": "x" * 60} for i in range(40_000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    began = time.monotonic()
    found = read_json_array(spark, [(0, str(tmp_path / "a.json"))], {"id": "id", "name": "name"})
    assert found.where("raw_id = __at AND __error IS NULL").count() == 40_000 and time.monotonic() - began < 60


def test_keys_of_a_duckdb_table_are_in_no_plan(spark, tmp_path):
    """They were rows of the plan itself, as objects on the driver: a table of millions ended it."""
    path = str(tmp_path / "t.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE t AS SELECT range AS id, CASE WHEN range % 3 > 0 THEN 'n' || range END AS name, DATE '2020-01-01' AS day, TIMESTAMP '2020-01-01 10:00:00' AS at, 1.50::DECIMAL(9, 2) AS d, range % 2 = 0 AS even FROM range(5)")
    table = tables.DuckDbTable(spark, path, "t")
    keys = table.keys(["id", "name", "day", "at", "d", "even"])
    assert "LocalRelation" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert dict(keys.dtypes) == {"id": "bigint", "name": "string", "day": "date", "at": "timestamp", "d": "decimal(9,2)", "even": "boolean"}
    with duckdb.connect(path) as con:
        assert sorted(map(tuple, keys.collect())) == sorted(con.execute("FROM t").fetchall())
    table.release()
    assert not table.spooled and tables.DuckDbTable(spark, path, "none").keys(["id"]) is None


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_xml_is_cut_anywhere(spark, tmp_path, size):
    """As parsing whole documents gives it, but in pieces."""
    rows = "".join(f"<row id='{i}'><n>é{i} &lt;row</n><!-- <row> --><m><![CDATA[</row><row>]]></m>{'<row id="in"/>' * (i % 7 == 0)}</row> t " for i in range(40))
    spaced = '<x:r xmlns:x="u"><x:row id="1"><x:n>a</x:n></x:row><y><x:row id="2"/></y></x:r>'
    texts = [f"<r>{rows}</r>", spaced, "<row id='0'/>", "<row id='0'></row>\n", "<r><rows/></r>", "", "<r><row id='1'/>", "<r><row id='1'/></r><row", "<r><row id='1'/></r>x", "<r><row id='1'><n></row></r>"]
    paths = [(i, str(tmp_path / f"{i}.xml")) for i in range(len(texts) + 1)]
    for (_, p), text in zip(paths, [t.encode() for t in texts] + [b"<r><row id='\xff'/></r>"], strict=True):
        Path(p).write_bytes(text)
    columns = {"id": "@id", "n": "n", "m": "m"}
    with small_splits(spark, size):
        found = read_xml(spark, paths, "row", columns).collect()
    bad = {r[FILE_ORD]: r["__error"].partition(":")[0] for r in found if r["__error"]}
    assert bad == {4: "xml_no_rows", **dict.fromkeys([5, 6, 7, 8, 9, 10], "xml_parse_error")}
    for i in (0, 1, 2, 3):
        got = [[r["raw_id"], r["raw_n"], r["raw_m"]] for r in sorted((r for r in found if r[FILE_ORD] == i), key=lambda r: r[AT])]
        assert got == rows_of(texts[i], "row", columns)


def test_xml_holds_no_document():
    """Neither the text nor the tree: a file of 225 MB took a worker's memory many times over."""
    parser, n = Elements("row", {"id": "id"}), 0
    parser.feed(b"<r>", False)
    tracemalloc.start()
    for _ in range(300):
        n += len(parser.feed(b"<row><id>1</id><t>" + b"x" * 1000 + b"</t></row><other>" + b"y" * 1000 + b"</other>", False))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert (n, parser.feed(b"</r>", True), len(parser.open)) == (300, [], 0) and held < 200_000
