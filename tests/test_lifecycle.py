"""Queue, versions, gate, stage log and workflow."""

import random

import pytest
from pyspark.sql import functions as F

from trafficwarden.operators import decide as D
from trafficwarden.operators import lifecycle as L
from trafficwarden.operators import metrics as M
from trafficwarden.sources import readers as S

EVAL = "struct<data_version:string,f1_macro:double,fpr:double,per_class_recall:map<string,double>>"
R = {"normal": 0.95, "union_based": 0.9}


@pytest.mark.parametrize(("candidate", "champion", "verdict", "comparison"), [
    (("1.1", 0.9, 0.01, R), None, "direct_promote", "no_champion"),
    (("2.0", 0.5, 0.5, R), ("1.3", 0.9, 0.01, R), "direct_promote", "cross_major_refused"),
    (("1.1", 0.9, 0.01, R), ("1.0", 0.9, 0.01, R), "promote", "same_major"),
    (("1.1", 0.89, 0.01, R), ("1.0", 0.9, 0.01, R), "reject", "same_major"),
    (("1.1", 0.95, 0.02, R), ("1.0", 0.9, 0.01, R), "reject", "same_major"),
    (("1.1", 0.95, 0.01, {**R, "union_based": 0.87}), ("1.0", 0.9, 0.01, R), "reject", "same_major"),
    (("1.1", 0.95, 0.01, {**R, "union_based": 0.89}), ("1.0", 0.9, 0.01, R), "promote", "same_major"),
    (("1.1", 0.95, 0.01, {**R, "stacked": 0.79}), ("1.0", 0.9, 0.01, R), "reject", "same_major"),
    (("1.1", 0.95, 0.01, {**R, "stacked": 0.8}), ("1.0", 0.9, 0.01, R), "promote", "same_major"),
])
def test_gate(spark, candidate, champion, verdict, comparison):
    row = L.gate(spark.createDataFrame([(candidate, champion)], f"candidate {EVAL}, champion {EVAL}")).first()
    assert (row.verdict, row.comparison) == (verdict, comparison)


def test_content_hash_ignores_order_and_tells_fields_apart(spark):
    h = lambda rows: L.content_hash(spark.createDataFrame(rows, "id string, label string")).first().content_hash
    assert h([("a", "1"), ("b", "2")]) == h([("b", "2"), ("a", "1")])
    assert h([("ab", "c")]) != h([("a", "bc")]) and h([("a", "1")]) != h([("a", "2")])


def test_stage_log(spark):
    log = [(1, "b1", "promote", "v1"), (2, "b1", "promote", "v2"), (3, "b1", "rollback", None), (4, "b2", "promote", "x"), (5, "b2", "clear", None), (6, "b3", "rollback", None)]
    events = spark.createDataFrame(log, "at long, branch string, action string, version string")
    assert {tuple(r) for r in L.stages(events).collect()} == {("b1", "v1", "production"), ("b1", "v2", "archived"), ("b2", "x", "archived")}
    base = spark.createDataFrame([("b1", "base"), ("b2", "base"), ("b3", "base")], "branch string, version string")
    assert {tuple(r) for r in L.resolve_active(events, base).collect()} == {("b1", "v1"), ("b2", "base"), ("b3", "base")}


def test_stages_of_long_logs(spark):
    """As a plain fold tells, whatever parts the log is dealt out in; no log is gathered in one row."""
    rng, log, want = random.Random(5), [], set()
    for b in range(12):
        live, old = None, []
        for at in range(rng.choice([1, 5, 400])):
            action, version = rng.choices(["promote", "rollback", "clear", "noise"], [4, [0, 2, 8][b % 3], [0, 1][b % 2], 1])[0], f"v{rng.randrange(6)}"
            log.append((at, f"b{b}", action, version if action == "promote" else None))
            archived = old if live is None else [live, *[v for v in old if v != live]]
            if action == "promote":
                live, old = version, [v for v in archived if v != version]
            elif action == "rollback" and old:
                live, old = old[0], [v for v in archived if v != old[0]]
            elif action == "clear":
                live, old = None, archived
        want |= {(f"b{b}", v, "archived") for v in old} | ({(f"b{b}", live, "production")} if live else set())
    rng.shuffle(log)
    events = spark.createDataFrame(log, "at long, branch string, action string, version string")
    assert {tuple(r) for r in L.stages(events).collect()} == want
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in L.stages(events).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    assert "collect_list" not in L.stages(events)._jdf.queryExecution().toString()


def test_whole_stage_log(spark):
    """No event of the table is left out, beyond the first few thousand keys either."""
    from trafficwarden.plans import metric_queries as Q

    d = "/root/testdata/sf0.01"
    k = F.col("o_orderkey")
    promoted = spark.read.parquet(f"{d}/orders.parquet").filter((k % 7 != 0) & (k % 31 != 0)).count()
    assert Q.QUERIES["g9_stages"](spark, d).agg(F.sum("n")).first()[0] == promoted


def test_seal_and_removal(spark):
    versions = spark.createDataFrame([("1.0", ["normal"], "h0", True), ("1.1", ["normal"], "h1", False)], "version string, label_space array<string>, content_hash string, protected boolean")
    new = spark.createDataFrame([("1.1", ["normal"], "h2"), ("1.1", ["normal", "stacked"], "h3"), ("1.1", ["normal"], "h1"), ("9.9", ["normal"], "h4"), (None, ["normal"], "h5")], "parent string, label_space array<string>, content_hash string")
    got = {r.content_hash: (r.bump, r.version, r.error) for r in L.seal(versions, new).collect()}
    assert got == {"h2": ("minor", "1.2", None), "h3": ("major", "2.0", None), "h1": ("minor", None, "content already sealed"), "h4": ("major", None, "unknown parent"), "h5": ("initial", "1.0", None)}
    names = spark.createDataFrame([("1.0",), ("1.1",), ("7.0",)], "version string")
    assert {tuple(r) for r in L.removable(versions, names).collect()} == {("1.0", "protected"), ("1.1", None), ("7.0", "unknown version")}


@pytest.mark.parametrize(("sqli", "anomaly", "session", "action"), [(None, None, None, "UNKNOWN"), (None, None, True, "BLOCK"), (True, False, False, "BLOCK"), (False, True, False, "OVERKILL"), (False, False, None, "ALLOW"), (False, None, None, "ALLOW"), (False, True, True, "BLOCK")])
def test_verdicts(spark, sqli, anomaly, session, action):
    assert D.decide(spark.createDataFrame([(sqli, anomaly, session)], "is_sqli boolean, is_anomaly boolean, session_attack boolean")).first().action == action


def test_run_id_is_one_definition(spark):
    assert L.run_id({"a": 1, "b": 2}, "h", 0) == L.run_id({"b": 2, "a": 1}, "h", 0) != L.run_id({"a": 1, "b": 2}, "h", 1)
    rows = [('{"b": 2, "a": 1}', "h", 0), ('{"a": "\u00e9"}', "h", 3), (None, "h", 1)]
    got = [r.run_id for r in L.run_ids(spark.createDataFrame(rows, "config string, data_hash string, seed int")).collect()]
    assert got == [L.run_id({"a": 1, "b": 2}, "h", 0), L.run_id({"a": "é"}, "h", 3), None]
    one = spark.createDataFrame([({"x": "1"}, "h", 0)], "config map<string,string>, data_hash string, seed int")
    assert L.run_ids(one).first().run_id == L.run_id({"x": "1"}, "h", 0)


def test_sweep_by_hand(spark):
    """Scores 1 to 100, the even ones attacks: percentiles lie between scores, and a threshold's own score isn't above it."""
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("score"), (F.col("id") % 2 == 0).alias("a"))
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in M.threshold_sweep(df, "score", F.col("a")).collect()}
    want = {round(1 + 0.99 * p, 6) for p in (5, 10, 20, 30, 40, 50, 60, 70, 80, 85, 90, 92, 94, 95, 96, 97, 98, 99)} | {0.0, 1.0, 100.0}
    assert set(got) == want and got[0.0] == (50, 50, 0, 0) and got[1.0] == (50, 49, 0, 1) and got[100.0] == (0, 0, 50, 50) and got[50.5] == (25, 25, 25, 25)


def test_active_version_follows_the_whole_log(spark):
    log = [(1, "b", "promote", "v1"), (2, "b", "promote", "v2"), (3, "b", "rollback", None), (4, "c", "promote", "v9"), (5, "c", "clear", None)]
    events = spark.createDataFrame(log, "at long, branch string, action string, version string")
    base = spark.createDataFrame([("b", "base"), ("c", "base"), ("d", "base")], "branch string, version string")
    assert {tuple(r) for r in L.resolve_active(events, base).collect()} == {("b", "v1"), ("c", "base"), ("d", "base")}


def test_sources(spark, tmp_path):
    (tmp_path / "d1.csv").write_text('"1 or 1=1",1\n"hello, world",0\n"1 or 1=1",0\nbad,7\n"  ",1\n')
    assert {tuple(r) for r in S.labelled_csv(spark, str(tmp_path / "d1.csv")).collect()} == {("1 or 1=1", True, "d1"), ("hello, world", False, "d1")}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.txt").write_text("x\n\ny\n")
    (tmp_path / "p/b.txt").write_text("y\nz\n")
    assert {r.raw_text for r in S.payload_files(spark, str(tmp_path / "p")).collect()} == {"x", "y", "z"}
    (tmp_path / "d7.csv").write_text("request,body,66 - SQL Injection,000 - Normal\n/a?x=%31,b,1,1\n/b,,0,1\n/c,,0,0\n")
    got = {tuple(r)[:2] for r in S.multilabel_csv(spark, str(tmp_path / "d7.csv"), ["request", "body", "66 - SQL Injection", "000 - Normal"], "request", "body").collect()}
    assert got == {("/a?x=1 b", True), ("/b", False)}
    (tmp_path / "dump.txt").write_text("junk\nGET /a HTTP/1.1\nHost: x\n\nPOST /b?q=1 HTTP/1.1\n\nbody=2\n")
    requests = S.http_dump(spark, str(tmp_path / "dump.txt"))
    assert [r.raw_request.split(" ")[0] for r in requests.orderBy("position").collect()] == ["GET", "POST"]
    texts = S.http_requests(requests.withColumn("label", F.lit("normal")).withColumn("split", F.lit("train")))
    assert {tuple(r) for r in texts.collect()} == {("/a", False, "d3"), ("/b?q=1 body=2", False, "d3")}
    (tmp_path / "na.csv").write_text('t,u\nNA,"null"\n"",x\n,y\n')
    schema = S.T.StructType([S.T.StructField("t", S.T.StringType()), S.T.StructField("u", S.T.StringType())])
    assert [tuple(r) for r in S.csv_keep_na(spark, str(tmp_path / "na.csv"), schema).collect()] == [("NA", "null"), ("", "x"), ("", "y")]


def test_ledger_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = S.T.StructType([S.T.StructField("a", S.T.LongType())])
    assert S.read_ledger(spark, path, schema).count() == 0
    S.append_ledger(spark.createDataFrame([(1,)], "a long"), path)
    S.append_ledger(spark.createDataFrame([(2,)], "a long"), path)
    (tmp_path / "ledger/extra.json").write_text('\n{"a": 3}\n{broken\n')
    assert sorted(r.a for r in S.read_ledger(spark, path, schema).collect()) == [1, 2, 3]


def test_invariants_stop_a_write(spark, tmp_path):
    from trafficwarden.operators import audit as A

    df = spark.createDataFrame([(1, "train")], "id long, split string")
    bad = A.invariants({"none": (df.agg(F.count("*").alias("n")), F.col("n") == 0)})
    with pytest.raises(ValueError, match="none"):
        A.write_if_sound(df, str(tmp_path / "out"), bad, "split")
