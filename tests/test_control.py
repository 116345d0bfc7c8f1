"""The contract's rules, inference, and the command line."""

import json
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F
from test_run import contract

from tidegate import api, cli
from tidegate.operators import merge
from tidegate.plans import catalogs, inputs
from tidegate.plans.config import ConfigError

XLSX = {"format": "xlsx", "path": "in"}


@pytest.mark.parametrize(
    ("root", "entity", "message"),
    [
        ({"version": "one"}, {}, "version=one"),
        ({"storages": {"definitions": [{"name": "a", "type": "ftp"}]}}, {}, "type=ftp"),
        ({"storages": {"definitions": [{"name": "a", "type": "s3", "bucket": "b"}]}}, {}, "requires region"),
        ({"storages": {"definitions": [{"name": "a", "type": "adls", "account": "b"}]}}, {}, "requires container"),
        ({"storages": {"default": "x", "definitions": [{"name": "a"}]}}, {}, "storages.default=x"),
        ({"storages": {"definitions": [{"name": "a"}, {"name": "a"}]}}, {}, "duplicated"),
        ({}, {"source": XLSX | {"options": {"header_row": 0}}}, "header_row must be greater"),
        ({}, {"source": XLSX | {"options": {"header_row": 2, "data_row": 2}}}, "data_row must be greater"),
        ({}, {"source": XLSX | {"options": {"sheet": " "}}}, "sheet must not be empty"),
        ({}, {"schema": {"columns": [{"name": "id", "type": "int"}], "unique_keys": [["id", "id"]]}}, "duplicate column"),
        ({}, {"schema": {"columns": [{"name": "id", "type": "int"}], "unique_keys": [[]]}}, "empty key"),
        ({}, {"schema": {"columns": [{"name": "id", "type": "int"}], "schema_evolution": {"mode": "add_columns"}}, "sink": {"accepted": {"format": "versioned", "path": "x"}, "rejected": {"format": "csv", "path": "r"}}}, "version >="),
        ({"storages": {"definitions": [{"name": "a", "type": "gcs", "bucket": "b"}]}}, {"sink": {"accepted": {"format": "duckdb", "path": "x", "storage": "a", "duckdb": {"table": "t"}}, "rejected": {"format": "csv", "path": "r"}}}, "not supported on gcs"),
        ({}, {"sink": {"accepted": {"format": "versioned", "path": "x", "merge": {"scd2": {"current_flag_column": "now"}}}, "rejected": {"format": "csv", "path": "r"}}}, "merge.scd2 is only supported"),
    ],
)
def test_rules(tmp_path, root, entity, message):
    c = Path(contract(tmp_path))
    raw = yaml.safe_load(c.read_text())
    raw.update(root)
    raw["entities"][0].update(entity)
    c.write_text(yaml.safe_dump(raw))
    with pytest.raises(ConfigError, match=message):
        api.validate(str(c))


S3 = {"storages": {"definitions": [{"name": "lake", "type": "s3", "bucket": "b", "region": "eu-west-1", "prefix": "top"}, {"name": "local"}]}}


def bound(tmp_path, catalog, accepted, name="things"):
    c = Path(contract(tmp_path))
    raw = yaml.safe_load(c.read_text())
    raw.update(S3 | {"catalogs": {"default": "main", "definitions": [{"name": "main", **catalog}]}})
    raw["entities"][0]["name"] = name
    raw["entities"][0]["sink"]["accepted"] = accepted
    c.write_text(yaml.safe_dump(raw))
    config = api.validate(str(c))
    return catalogs.binding(config, config.entities[0])


def test_catalogs(tmp_path):
    iceberg = {"format": "iceberg", "path": "t", "storage": "lake", "iceberg": {"namespace": "n.m"}}
    b = bound(tmp_path, {"type": "rest", "uri": "http://x", "credential": "client_credentials:id:secret", "warehouse": "w", "scope": "s"}, iceberg)
    assert b.table == "`main`.`n`.`m`.`things`" and b.namespace == "`main`.`n`.`m`"
    assert b.settings == {"spark.sql.catalog.main": catalogs.ICEBERG, "spark.sql.catalog.main.type": "rest", "spark.sql.catalog.main.uri": "http://x", "spark.sql.catalog.main.warehouse": "w", "spark.sql.catalog.main.credential": "id:secret", "spark.sql.catalog.main.scope": "s"}
    b = bound(tmp_path, {"type": "glue", "region": "eu-west-1", "database": "d", "warehouse_storage": "lake", "warehouse_prefix": "wh"}, iceberg | {"iceberg": {"table": "t"}})
    assert b.table == "`main`.`d`.`t`" and b.settings["spark.sql.catalog.main.warehouse"] == "s3a://b/top/wh" and b.settings["spark.sql.catalog.main.client.region"] == "eu-west-1"
    unity = {"type": "unity", "host": "http://u", "catalog": "c", "schema": "s", "token": "t"}
    b = bound(tmp_path, unity, {"format": "delta", "path": "t", "storage": "lake", "delta": {}})
    assert b.table == "`main`.`s`.`things`" and b.namespace is None and b.settings["spark.sql.catalog.main.token"] == "t"
    assert bound(tmp_path, unity, {"format": "delta", "path": "t"}) is None
    for catalog, accepted, message in (
        (unity, iceberg, "does not hold iceberg"),
        ({"type": "rest"}, iceberg, "requires uri"),
        ({"type": "rest", "uri": "x"}, iceberg | {"iceberg": {"catalog": "other"}}, "unknown catalog other"),
        ({"type": "rest", "uri": "x"}, iceberg | {"storage": "local"}, "requires sink.accepted storage"),
        (unity, {"format": "parquet", "path": "t", "delta": {}}, "only supported for"),
        ({"type": "hive"}, iceberg, "type=hive"),
    ):
        with pytest.raises(ConfigError, match=message):
            bound(tmp_path, catalog, accepted)


def test_tables_are_registered_once(spark, tmp_path):
    """By Spark's own catalog."""
    at = f"file:{tmp_path}/t"
    spark.range(3).write.parquet(at)
    for _ in range(2):
        catalogs.register(spark, "`default`.`tidegate_registered`", "parquet", at)
    assert spark.table("default.tidegate_registered").count() == 3
    spark.sql("DROP TABLE default.tidegate_registered")


def test_merge_statements():
    sql = merge.scd1_statement("t", "s", ["id", "a", "b"], ["id"], ["b"])
    assert sql == "MERGE INTO t t USING s s ON t.`id` = s.`id` WHEN MATCHED THEN UPDATE SET t.`a` = s.`a` WHEN NOT MATCHED THEN INSERT (`id`, `a`, `b`) VALUES (s.`id`, s.`a`, s.`b`)"
    assert "AND t.`__dq_is_current` AND s.__close WHEN MATCHED THEN UPDATE" in merge.scd2_statement("t", "s", ["id", "a"], ["id"])


def test_staged_history_is_the_merge(spark):
    """What the MERGE would do with the staged rows, done by hand, is what scd2 gives."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = merge.history(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, v string")
    staged = [(r["id"], r["v"], r["__close"]) for r in merge.scd2_staged(old, new, ["id"], ["v"], now).collect()]
    assert sorted(staged) == [(2, "x", False), (2, "x", True), (4, "d", False)]
    want = sorted((r["id"], r["v"], r["__dq_is_current"]) for r in merge.scd2(old, new, ["id"], ["v"], now).collect())
    closed = {i for i, _, c in staged if c}
    assert want == sorted([(r["id"], r["v"], r["id"] not in closed) for r in old.collect()] + [(i, v, True) for i, v, c in staged if not c])


def test_storages(spark, tmp_path):
    """Where paths lie, and what Hadoop is told of buckets; listing them goes through the code that file:
    URIs go through."""
    c = Path(contract(tmp_path))
    raw = yaml.safe_load(c.read_text())
    raw["storages"] = {"default": "a", "definitions": [{"name": "a", "type": "s3", "bucket": "b", "region": "eu-west-1", "prefix": "/top/", "endpoint": "http://x", "path_style_access": True}, {"name": "g", "type": "gcs", "bucket": "h"}, {"name": "z", "type": "adls", "account": "acc", "container": "con", "prefix": "p"}, {"name": "l"}]}
    c.write_text(yaml.safe_dump(raw))
    config = api.validate(str(c))
    assert [inputs.located(config, "/in/x", s) for s in (None, "g", "z")] == ["s3a://b/top/in/x", "gs://h/in/x", "abfss://con@acc.dfs.core.windows.net/p/in/x"]
    assert inputs.located(config, "in", "l") == str(tmp_path / "in") and inputs.located(config, "gs://k/in", None) == "gs://k/in"
    inputs.configure(spark, config)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert [conf.get(f"fs.s3a.bucket.b.{k}") for k in ("endpoint", "endpoint.region", "path.style.access")] == ["http://x", "eu-west-1", "true"]


def test_profiles(tmp_path):
    c = Path(contract(tmp_path))
    raw = yaml.safe_load(c.read_text())
    raw["entities"][0]["sink"]["accepted"] |= {"storage": "lake", "path": "${WHERE}"}
    c.write_text(yaml.safe_dump(raw))
    p = tmp_path / "p.yml"
    p.write_text(yaml.safe_dump({"metadata": {"name": "x"}, "variables": {"WHERE": "a/b"}, "execution": {"runner": {"type": "local"}}, **S3}))
    config = api.validate(str(c), str(p))
    assert config.entities[0].sink.accepted.path == "a/b" and config.storages.definitions[0].bucket == "b"
    for change, message in (({"metadata": {"name": " "}}, "name must not be empty"), ({"execution": {"runner": {"type": "cron"}}}, "runner.type=cron"), ({"variables": {"A": "${b c}"}}, "malformed"), ({"storages": {"default": "x"}}, "definitions must not be empty")):
        p.write_text(yaml.safe_dump({"variables": {"WHERE": "a"}, **S3} | change))
        with pytest.raises(ConfigError, match=message):
            api.validate(str(c), str(p))


def test_inference(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("id,Price,when,ok,name\n1,2.5,2024-01-31,true,x\n2,,2024-02-01,false,\n")
    got = api.infer_contract(spark, str(tmp_path / "a b.csv"), "csv")
    assert [(c["name"], c["type"]) for c in got["schema"]["columns"]] == [("id", "integer"), ("Price", "number"), ("when", "date"), ("ok", "boolean"), ("name", "string")]
    assert got["name"] == "a_b" and got["source"]["options"]["separator"] == ","
    (tmp_path / "n.json").write_text('{"id": 1, "tag": "x"}\n{"id": 2}\n')
    got = api.infer_contract(spark, str(tmp_path / "n.json"), "json", "things")
    assert got["source"]["options"] == {"json_mode": "ndjson"} and [c["type"] for c in got["schema"]["columns"]] == ["number", "string"]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="is empty"):
        api.infer_contract(spark, str(tmp_path / "e.csv"), "csv")


def test_command_line(spark, tmp_path, capsys):
    c = contract(tmp_path, files={"a.csv": "id;name\n1;x\n"}, incremental_mode="file", write_mode="append")
    assert cli.main(["validate", "-c", c]) == 0 and "valid" in capsys.readouterr().out
    assert cli.main(["run", "-c", c, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["previews"][0]["files"] == [str(tmp_path / "in/a.csv")]
    assert cli.main(["run", "-c", c, "--entities", "e"]) == 0
    assert json.loads(capsys.readouterr().out)["entities"][0]["accepted"] == 1
    assert cli.main(["state", "inspect", "-c", c, "--entity", "e"]) == 0 and len(json.loads(capsys.readouterr().out)["files"]) == 1
    assert cli.main(["state", "reset", "-c", c, "--entity", "e"]) == 0 and "True" in capsys.readouterr().out
    assert cli.main(["manifest", "-c", c, "-o", str(tmp_path / "m.json"), "--deterministic"]) == 0
    assert cli.main(["run", "--manifest", str(tmp_path / "m.json"), "--dry-run"]) == 0
    capsys.readouterr()
    (tmp_path / "more.csv").write_text("k,v\n1,x\n2,y\n")
    assert cli.main(["add-entity", "-c", c, "--input", str(tmp_path / "more.csv"), "--format", "csv"]) == 0
    assert [e["name"] for e in yaml.safe_load(Path(c).read_text())["entities"]] == ["e", "more"]
    assert cli.main(["validate", "-c", str(tmp_path / "none.yml")]) == 1
