"""Contracts end to end: files in, accepted and rejected rows and reports out."""

import json
import zipfile
from pathlib import Path

import pytest
import yaml

from tidegate import api
from tidegate.plans.config import ConfigError
from avro_files import encode


def contract(tmp: Path, fmt="csv", columns=None, severity="reject", files=None, **more) -> str:
    folder = tmp / "in"
    folder.mkdir(exist_ok=True)
    for name, body in (files or {}).items():
        (folder / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    sink = {"accepted": {"format": "parquet", "path": "out/accepted"}, "rejected": {"format": "csv", "path": "out/rejected"}}
    sink["accepted"].update(more.pop("accepted", {}))
    if "write_mode" in more:
        sink["write_mode"] = more.pop("write_mode")
    source = {"format": fmt, "path": "in", **({"options": more.pop("options")} if "options" in more else {}), **({"cast_mode": more.pop("cast_mode")} if "cast_mode" in more else {})}
    schema = {"columns": columns or [{"name": "id", "type": "string"}, {"name": "name", "type": "string"}], **more.pop("schema", {})}
    entity = {"name": "e", "source": source, "sink": sink, "policy": {"severity": severity}, "schema": schema, **more}
    path = tmp / "config.yml"
    path.write_text(yaml.safe_dump({"version": "0.1", "report": {"path": "report"}, "entities": [entity]}))
    return str(path)


def accepted(spark, tmp, path="out/accepted"):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp / path)).collect())


UNIQUE_ID = [{"name": "id", "type": "string", "unique": True}, {"name": "name", "type": "string"}]


def test_unique_across_files(spark, tmp_path):
    c = contract(tmp_path, columns=UNIQUE_ID, files={"a.csv": "id;name\n1;alice\n2;bob\n", "b.csv": "id;name\n2;carol\n3;dave\n"})
    out = api.run(spark, c, run_id="r1")
    (e,) = out.entities
    assert out.exit_code == 0 and e.status == "rejected" and (e.rows, e.accepted, e.rejected) == (4, 3, 1), out
    assert [f.status for f in e.files] == ["success", "rejected"]
    assert accepted(spark, tmp_path) == [("1", "alice"), ("2", "bob"), ("3", "dave")]
    rejected = spark.read.options(header=True, escape='"').csv(str(tmp_path / "out/rejected")).collect()
    assert [(r["id"], r["__dq_row_index"]) for r in rejected] == [("2", "0")]
    assert json.loads(rejected[0]["__dq_errors"])[0]["rule"] == "unique"
    assert json.loads((tmp_path / "report/run_r1/e/run.json").read_text())["accepted"] == 3
    assert e.unique[0]["duplicates"] == 1


def test_append_sees_what_is_there(spark, tmp_path):
    c = contract(tmp_path, columns=UNIQUE_ID, write_mode="append", files={"a.csv": "id;name\n1;alice\n2;bob\n"})
    assert api.run(spark, c).entities[0].accepted == 2
    (tmp_path / "in/a.csv").write_text("id;name\n2;bob\n3;carol\n")
    e = api.run(spark, c).entities[0]
    assert (e.accepted, e.rejected) == (1, 1), e
    assert len(accepted(spark, tmp_path)) == 3


def test_cast_modes_and_abort(spark, tmp_path):
    columns = [{"name": "id", "type": "integer"}, {"name": "name", "type": "string"}]
    files = {"a.csv": "id;name\n1;alice\n", "b.csv": "id;name\nx;bob\n2;carol\n", "c.csv": "id;name\n3;dave\n"}
    c = contract(tmp_path, columns=columns, severity="abort", files=files)
    out = api.run(spark, c)
    assert out.exit_code == 2 and accepted(spark, tmp_path) == [(1, "alice")]
    assert [f.status for f in out.entities[0].files] == ["success", "aborted", "skipped"]
    assert (tmp_path / "out/rejected/b.csv").read_text() == files["b.csv"]
    c = contract(tmp_path, columns=columns, severity="warn", cast_mode="coerce", files=files)
    assert api.run(spark, c).entities[0].accepted == 4
    assert (None, "bob") in {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()}


@pytest.mark.parametrize(
    ("body", "schema", "severity", "status", "action"),
    [
        ("id\n77\n78\n", {}, "warn", "success", "filled_nulls"),
        ("id\n77\n78\n", {"mismatch": {"missing_columns": "reject_file"}}, "reject", "rejected", "rejected_file"),
        ("id;name;note\n77;kees;x\n78;liv;y\n", {}, "warn", "success", "ignored_extras"),
        ("id;name;note\n77;kees;x\n", {"mismatch": {"extra_columns": "reject_file"}}, "abort", "aborted", "aborted"),
        ("id\n77\n78\n", {"mismatch": {"missing_columns": "reject_file"}}, "warn", "success_with_warnings", "filled_nulls"),
    ],
)
def test_mismatch(spark, tmp_path, body, schema, severity, status, action):
    out = api.run(spark, contract(tmp_path, schema=schema, severity=severity, files={"a.csv": body}))
    assert out.entities[0].status == status
    assert out.entities[0].files[0].mismatch["action"] == action


def test_formats(spark, tmp_path):
    number = [{"name": "id", "type": "string"}, {"name": "amount", "type": "number"}]

    def counts(sub, **kw):
        (tmp_path / sub).mkdir()
        e = api.run(spark, contract(tmp_path / sub, **kw)).entities[0]
        assert e.status in ("success", "rejected"), e
        return e.accepted, e.rejected, e.files[0].error

    fixed = [{"name": "id", "type": "integer", "width": 3}, {"name": "qty", "type": "integer", "width": 4}]
    assert counts("fixed", fmt="fixed", columns=fixed, files={"a.txt": "0420007\nx1y0031\n"}) == (1, 1, None)
    assert counts("tsv", fmt="tsv", files={"a.tsv": "id\tname\textra\n1\ta\tskip\n"}) == (1, 0, None)
    assert counts("json", fmt="json", files={"a.json": '[{"id":"1","name":"Ada"},{"id":"2","extra":"x"}]'}) == (2, 0, None)
    assert counts("bad", fmt="json", files={"a.json": "{bad}"})[2].startswith("json_parse_error")
    nested = [{"name": "id", "type": "string"}, {"name": "user", "type": "string", "source": "user"}]
    assert "json_selector_non_scalar" in counts("nested", fmt="json", columns=nested, files={"a.json": '[{"id":"1","user":{"name":"Ada"}}]'})[2]
    nd = dict(fmt="json", options={"json_mode": "ndjson"})
    assert counts("nd", **nd, files={"a.json": '{"id":"1","name":"a"}\n\n{"id":"2"}\n'}) == (2, 0, None)
    assert counts("ndbad", **nd, files={"a.json": '{"id":"1","name":"a"}\n{bad}\n'})[2] == "json_parse_error"
    attrs = [{"name": "id", "type": "string", "source": "@id"}, {"name": "name", "type": "string", "source": "n"}]
    assert counts("xml", fmt="xml", columns=attrs, options={"row_tag": "row"}, files={"a.xml": '<rows><row id="1"><n> A<b>d</b>a</n></row><row id="2"/></rows>'}) == (2, 0, None)
    assert counts("xmlbad", fmt="xml", columns=attrs, options={"row_tag": "row"}, files={"a.xml": "<rows/>"})[2].startswith("xml_no_rows")
    avro = encode([("id", "string"), ("amount", "string"), ("tags", {"type": "array", "items": "string"})], [{"id": "1", "amount": "1", "tags": ["x"]}, None, {"id": "2", "amount": "bad", "tags": []}], union=True, codec="deflate")
    assert counts("avro", fmt="avro", columns=number, files={"a.avro": avro}) == (2, 1, None)
    book = tmp_path / "a.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>amount</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>1.5</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="B3" t="inlineStr"><is><t>bad</t></is></c></row></sheetData></worksheet>')
    assert counts("xlsx", fmt="xlsx", columns=number, files={"a.xlsx": book.read_bytes()}) == (1, 1, None)
    for kind in ("parquet", "orc"):
        (tmp_path / kind).mkdir()
        spark.createDataFrame([("1", "1"), ("2", "bad")], "id string, amount string").coalesce(1).write.format(kind).save(str(tmp_path / kind / "in"))
        assert counts_of(spark, contract(tmp_path / kind, fmt=kind, columns=number)) == (1, 1)


def counts_of(spark, c):
    e = api.run(spark, c).entities[0]
    return e.accepted, e.rejected


def test_large_csv_keeps_row_numbers(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = "\n".join(f"{i};{'bad' if i % 500 == 7 else i}" for i in range(5000))
        c = contract(tmp_path, columns=[{"name": "id", "type": "integer"}, {"name": "n", "type": "integer"}], files={"a.csv": f"id;n\n{rows}\n"})
        assert counts_of(spark, c) == (4990, 10)
        got = spark.read.option("header", True).csv(str(tmp_path / "out/rejected")).select("id", "__dq_row_index").collect()
        assert sorted(int(r[0]) for r in got) == sorted(int(r[1]) for r in got) == [500 * i + 7 for i in range(10)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


KEYED = [{"name": "id", "type": "string"}, {"name": "country", "type": "string"}, {"name": "name", "type": "string"}]


@pytest.mark.parametrize("sink", ["versioned", "duckdb"])
def test_merges(spark, tmp_path, sink):
    target = {"format": sink, "path": "out/t.duckdb" if sink == "duckdb" else "out/t", **({"duckdb": {"table": "t"}} if sink == "duckdb" else {})}
    (tmp_path / "out").mkdir()
    for mode, want in (("merge_scd1", {"inserted": 1, "updated": 1, "rows_before": 2, "rows_after": 3}), ("merge_scd2", {"inserted": 2, "closed": 1, "unchanged": 1, "rows_before": 2, "rows_after": 4})):
        target["path"] = f"out/{mode}" + (".duckdb" if sink == "duckdb" else "")
        second = "id;country;name\n7;nl;kees jan\n9;pt;rui\n" if mode == "merge_scd1" else "id;country;name\n7;nl;kees jan\n8;se;liv\n9;pt;rui\n"
        kw = dict(columns=KEYED, accepted=target, write_mode=mode, severity="warn", schema={"primary_key": ["id", "country"]})
        api.run(spark, contract(tmp_path, files={"a.csv": "id;country;name\n7;nl;kees\n8;se;liv\n"}, **kw))
        e = api.run(spark, contract(tmp_path, files={"a.csv": second}, **kw)).entities[0]
        assert e.merge is not None and {k: e.merge[k] for k in want} == want, e


def test_incremental_files(spark, tmp_path):
    c = contract(tmp_path, incremental_mode="file", write_mode="append", files={"a.csv": "id;name\n1;alice\n"})
    assert api.run(spark, c).entities[0].accepted == 1
    assert api.run(spark, c).entities[0].files == []
    (tmp_path / "in/a.csv").write_text("id;name\n1;alice\n2;bob\n")
    e = api.run(spark, c).entities[0]
    assert e.files == [] and e.warnings == 1
    assert len(api.inspect_state(c, "e")["files"]) == 1
    assert api.reset_state(c, "e")
    assert api.run(spark, c).entities[0].accepted == 2


def test_masking_manifest_and_dry_run(spark, tmp_path):
    pii = {"columns": [{"name": "name", "strategy": "mask", "mask_pattern": "{first2}****{last2}"}]}
    c = contract(tmp_path, pii=pii, files={"a.csv": "id;name\n1;hello\n"})
    assert api.run(spark, c, dry_run=True).previews[0]["files"][0].endswith("a.csv")
    out = api.run_manifest(spark, api.generate(c, deterministic=True))
    assert out.status == "success" and accepted(spark, tmp_path) == [("1", "he****lo")]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"policy": {"severity": "loud"}}, "policy.severity=loud"),
        ({"extra": 1}, "unknown key extra"),
        ({"pii": {"columns": [{"name": "id", "strategy": "tokenize"}]}}, "reserved"),
        ({"schema": {"columns": [{"name": "id", "type": "blob"}]}}, "unsupported column type"),
        ({"schema": {"primary_key": ["nope"], "columns": [{"name": "id", "type": "int"}]}}, "not declared"),
    ],
)
def test_invalid_contracts(tmp_path, change, message):
    c = Path(contract(tmp_path))
    raw = yaml.safe_load(c.read_text())
    raw["entities"][0].update(change)
    c.write_text(yaml.safe_dump(raw))
    with pytest.raises(ConfigError, match=message):
        api.validate(str(c))
