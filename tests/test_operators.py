"""Operators against small cases and models."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegate.functions import casts, masks, names, selectors
from tidegate.operators import checks, merge, mismatch, policy, unique
from tidegate.plans.lineage import Emitter
from tidegate.plans.state import Ledger
from tidegate.storage import Files, InputFile


def test_names():
    assert [names.normalize_name(x, "snake_case") for x in ("Customer ID", "customerID2Name", "HTTPServer", "Été x", "a__b")] == ["customer_id", "customer_id2_name", "http_server", "t_x", "a_b"]
    assert names.normalize_name("Customer ID", "camel_case") == "customerId" and names.normalize_name("Customer ID", "lower") == "customerid"
    with pytest.raises(names.NameCollision):
        names.normalize_all(["a b", "A_B"], "snake_case")


def test_casts(spark):
    cells = {"int8": [" 1 ", "127", "128", "1.5", "-1", "x", None], "uint64": ["18446744073709551615", "18446744073709551616", "-1", None], "boolean": [" TRUE ", "0", "yes", None], "date": ["2024-02-29", "2024-02-30", "2024-1-5", "2024"], "datetime": ["2024-01-01T10:00:00Z", "2024-01-01", "2024-01-01 25:00:00", "bad-date"], "double": ["1e3", "1d", ".5", "inf"]}
    want = {"int8": [None, 127, None, None, -1, None, None], "uint64": [18446744073709551615, None, None, None], "boolean": [True, False, None, None], "date": ["2024-02-29", None, None, None], "datetime": ["2024-01-01 10:00:00", "2024-01-01 00:00:00", None, None], "double": [1000.0, None, 0.5, float("inf")]}
    for kind, values in cells.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = [r[0] for r in df.select("i", casts.typed(F.col("v"), kind).alias("x")).orderBy("i").select("x").collect()]
        assert [str(g) if kind in ("date", "datetime") and g is not None else g for g in got] == want[kind], kind
    with pytest.raises(ValueError):
        casts.canonical("blob")


def test_masks(spark):
    df = spark.createDataFrame([("4111222233334444",), ("日本",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(masks.mask_value(F.col("v"), "{first4}****{last4}")).collect()]
    assert got == ["4111****4444", "****日本", "****", None]
    assert df.where("v = ''").select(masks.hashed(F.col("v"))).first()[0].startswith("e3b0c442")


def test_selectors(spark):
    df = spark.createDataFrame([('{"a":{"b":[{"c":"{x"},2]},"n":null}',)], "j string").select(F.try_parse_json("j").alias("v"))
    pick = lambda s: tuple(df.select(*selectors.select_json(F.col("v"), s)).first())
    assert pick("a.b[0].c") == ("{x", False) and pick("a.b[1]") == ("2", False) and pick("a.b[9]") == (None, False)
    assert pick("a.b[0]") == ('{"c":"{x"}', True) and pick("n") == (None, False)
    for bad in ("", "a..b", "a[x]", ".a"):
        with pytest.raises(ValueError):
            selectors.json_path(bad)


def test_formats(spark):
    errors = checks.gathered([F.when(F.lit(True), checks.error("not_null", "customer_id", "missing")), F.when(F.lit(True), checks.error("unique", "order_id", 'du"plicate'))])
    row = spark.range(1).select(*[checks.format_errors(errors, k).alias(k) for k in ("json", "csv", "text")]).first()
    assert row["csv"] == '"not_null,customer_id,missing\\nunique,order_id,du\\"plicate"'
    assert row["json"].startswith('[{"rule":"not_null","column":"customer_id","message":"missing"}')
    assert row["text"] == '"not_null:customer_id missing; unique:order_id du\\"plicate"'


rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("xy"))), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows, st.sets(st.tuples(st.integers(0, 3), st.sampled_from("xy")), max_size=3))
def test_uniqueness_is_a_seen_set(spark, data, taken):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a int, b string")
    seed = spark.createDataFrame(list(taken) + [(None, "x")], "a int, b string")
    got = {r["i"]: r["d"] for r in unique.with_duplicates(df, ["a", "b"], ["i"], "d", seed).collect()}
    seen, want = set(taken), {}
    for i, key in enumerate(data):
        want[i] = None not in key and key in seen
        seen.add(key)
    assert got == want


def test_severities(spark):
    df = spark.createDataFrame([(f, r, f == 1 and r == 1) for f in range(3) for r in range(2)], "__file_ord long, __row_index long, bad boolean")
    df = df.withColumn(checks.ERRORS, checks.gathered([F.when(F.col("bad"), checks.error("not_null", "x", "m"))]))
    out = policy.route(df, "abort")
    assert out.stopped == 1 and out.accepted.count() == 2 and out.rejected.count() == 2 and out.error_rows.count() == 1
    assert policy.route(df, "warn").accepted.count() == 6 and policy.route(df, "reject").rejected.count() == 1


def test_scd2_is_two_phases(spark):
    rng = random.Random(3)
    for _ in range(3):
        cell = lambda: rng.choice([None, 1, 2])
        old = [(k, cell(), rng.random() < 0.7) for k in range(6) for _ in range(rng.randint(0, 1))]
        new = [(k, cell()) for k in range(8) if rng.random() < 0.6]
        now, first = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), "2025-01-01 00:00:00"
        names_ = merge.HistoryNames()
        target = spark.createDataFrame(old, "k int, v int, __dq_is_current boolean").withColumn(names_.valid_from, F.lit(first).cast("timestamp_ntz")).withColumn(names_.valid_to, F.lit(None).cast("timestamp_ntz"))
        source = spark.createDataFrame(new, "k int, v int")
        got = sorted(((r[0], r[1], r[2], r[4] is not None) for r in merge.scd2(target, source, ["k"], ["v"], now).collect()), key=str)
        by = dict(new)
        closed = [(k, v, c and not (k in by and by[k] != v), c and k in by and by[k] != v) for k, v, c in old]
        inserted = [(k, v, True, False) for k, v in new if not any(c[0] == k and c[2] for c in closed)]
        assert got == sorted(closed + inserted, key=str)


def test_evolution(spark):
    a, b = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2, "x")], "id long, email string")
    assert sorted(map(tuple, merge.append(a, b, "add_columns").collect()), key=str) == [(1, None), (2, "x")]
    for target, source, mode in ((a, b, "strict"), (b, a, "add_columns")):
        with pytest.raises(merge.SchemaConflict):
            merge.append(target, source, mode)


def test_mismatch_lists():
    plan = mismatch.plan_mismatch(["b", "a"], ["a", "z", "y"], severity="reject")
    assert (plan.missing, plan.extra, plan.action) == (["b"], ["y", "z"], "filled_nulls")


def test_ledger(tmp_path):
    now = [0.0]
    ledger = Ledger(Files(), str(tmp_path / "state.json"), "e", clock=lambda: now[0])
    files = [InputFile("a", 1, 1.0), InputFile("b", 1, 1.0)]
    assert ledger.claim("r1", files).taken == files
    other = ledger.claim("r2", files)
    assert other.taken == [] and len(other.warnings) == 2
    now[0] = 4000.0
    assert ledger.claim("r2", files).taken == files
    ledger.commit("r2")
    assert ledger.claim("r3", files).taken == [] and ledger.claim("r3", [InputFile("a", 2, 1.0)]).warnings
    assert ledger.claim("r4", files, full=True).taken == files
    ledger.release("r4")
    assert ledger.read()["claims"] == {}


def test_lineage_goes_silent():
    from tidegate.plans.config import Entity, Lineage, Schema, Sink, Source, Target

    calls = []

    def fail(*a):
        calls.append(a)
        raise OSError

    e = Entity("e", Source("csv", "in"), Sink(Target("parquet", "out")), Schema([]))
    emitter = Emitter(Lineage("http://x", "ns", max_failures=2), "r", fail)
    assert [emitter.start(e) for _ in range(4)] == [False] * 4 and len(calls) == 6


def test_streaming(spark, tmp_path):
    from tidegate.streaming.ingest import ingest_available

    (tmp_path / "in").mkdir()
    seen = []
    for name, body in (("a", "id;n\n1;1\n2;x\n"), ("b", "id;n\n;3\n")):
        (tmp_path / f"in/{name}.csv").write_text(body)
        ingest_available(spark, str(tmp_path / "in"), [("id", "string", True), ("n", "int", False)], str(tmp_path / "ck"), lambda a, r, k: seen.append((a.count(), r.count()))).awaitTermination()
    assert seen == [(1, 1), (0, 1)]


def test_queries_have_oracles(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 40
    assert entry.entry(spark).count() > 0
