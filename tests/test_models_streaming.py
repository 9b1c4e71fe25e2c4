"""Detectors on made data, and streams against batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficwarden.operators import metrics as M
from trafficwarden.operators import models as ML
from trafficwarden.operators.curate import stratified_split
from trafficwarden.operators.neighbours import NeighbourSearch
from trafficwarden.plans.stream_queries import _rows, in_order
from trafficwarden.plans.text_queries import tagged
from trafficwarden.streaming import jobs as J

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(0)
    benign, odd = rng.normal(0, 1, (300, 4)), rng.normal(5, 1, (50, 4))
    rows = [(i, r.tolist(), i >= 300) for i, r in enumerate(np.concatenate([benign, odd]))]
    df = spark.createDataFrame(rows, "id long, x array<double>, is_attack boolean")
    return df.filter("id < 200").cache(), df.filter("id >= 200").cache()


@pytest.mark.parametrize("name", ["local_outlier_factor", "isolation_forest", "one_class_svm"])
def test_odd_rows_score_higher(clouds, name):
    assert M.auc(ML.detector_scores(name, *clouds), "anomaly_score", F.col("is_attack")).first().auc > 0.9


def plain_neighbours(queries, train, k):
    out = []
    for i, q in queries:
        near = sorted((float(np.sqrt(((np.array(q) - np.array(t)) ** 2).sum())), j) for j, t in train if j != i)[:k]
        out += [(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "shape"), [(1, "even"), (3, "clusters"), (4, "copies"), (12, "clusters")])
def test_neighbours_are_those_of_all_pairs(spark, dims, shape):
    rng = np.random.default_rng(dims)
    x = rng.normal(0, 1, (600, dims)) if shape == "even" else rng.normal(0, 0.01, (600, dims)) + rng.integers(0, 4, (600, 1)) * 5.0
    if shape == "copies":
        x = np.round(x)  # most rows are copies of a few
        x[300:500] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [100.0] * dims)]
    asked = rows[::3] + [(10_000 + i, (v + rng.normal(0, 0.5, dims)).tolist()) for i, v in enumerate(x[:60])]
    frame = lambda r: spark.createDataFrame(r, "id long, x array<double>")
    search = NeighbourSearch(frame(rows), 5, rows=16)
    got = sorted((r.id, r.n, r.neighbour, round(r.distance, 9)) for r in search.nearest(frame([*asked, (20_000, None)])).collect())
    assert search.tree.leaves > 1 and got == plain_neighbours(asked, rows, 5)
    few = NeighbourSearch(frame(rows[:3]), 5).nearest(frame(asked[:4])).collect()
    assert sorted((r.id, r.n, r.neighbour, round(r.distance, 9)) for r in few) == plain_neighbours(asked[:4], rows[:3], 5)
    assert NeighbourSearch(frame(rows).limit(0), 5).nearest(frame(asked)).count() == 0 and NeighbourSearch(frame(rows), 5).nearest(frame(asked).limit(0)).count() == 0


def test_compared_pairs_grow_little(spark):
    """Four times the rows on both sides: under 4 ** 1.2 times the pairs, where all pairs would be 16 times as many."""
    pairs = []
    for n in (4_000, 16_000):
        rows = spark.range(n).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) for i in range(3)]).alias("x"))
        search = NeighbourSearch(rows, 5, rows=64)
        assert search.nearest(rows).count() == 5 * n
        pairs.append(search.compared())
    assert pairs[1] < pairs[0] * 4**1.2 and pairs[1] < 0.1 * 16_000**2


def test_classifier_quality_and_round_trip(spark, tmp_path):
    rows = stratified_split(tagged(spark, DATA), "label_name", "id", 0.25).cache()
    model = ML.fit_classifier(rows.filter("split = 'train'"), vocabulary=2000, iterations=30)
    test = rows.filter("split = 'test'")
    scored = ML.classify(model, test)
    assert M.summary(M.confusion(scored)).first().f1_macro >= 0.95
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.classify(ML.load_model(str(tmp_path / "m")), test)
    assert {tuple(r) for r in scored.select("id", "predicted").collect()} == {tuple(r) for r in again.select("id", "predicted").collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream")
    in_order(_rows(spark, DATA), str(path))
    return path


def test_verdicts_equal_batch(spark, folder):
    J.run_to_end(J.verdicts(J.events(spark, f"{folder}/in")), f"{folder}/v", f"{folder}/vs")
    batch = J.verdicts(spark.read.parquet(f"{folder}/in"))
    keep = ["id", "action", "query_canonical"]
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/v").select(*keep).collect()} == {tuple(r) for r in batch.select(*keep).collect()}


def test_closed_windows_and_sessions_equal_batch(spark, folder):
    J.run_to_end(J.window_rates(J.events(spark, f"{folder}/in")), f"{folder}/w", f"{folder}/ws")
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/w").collect()}
    want = {tuple(r) for r in J.window_rates(spark.read.parquet(f"{folder}/in")).collect()}
    assert got <= want and len(want) - len(got) <= 1
    J.run_to_end(J.session_rollup(J.events(spark, f"{folder}/in")), f"{folder}/s", f"{folder}/ss")
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/s").collect()}
    want = {tuple(r) for r in J.session_rollup(spark.read.parquet(f"{folder}/in")).collect()}
    assert got <= want and len(got) > 0.9 * len(want)


def test_count_windows(spark, folder):
    J.count_window_counts(J.events(spark, f"{folder}/in"), [0.5], 100, f"{folder}/c", f"{folder}/cs")
    rows = spark.read.parquet(f"{folder}/c").filter("window is not null").groupBy("window").agg(F.sum("n").alias("n")).collect()
    assert sorted(r.n for r in rows) == [100] * 10


def test_a_repeated_batch_and_a_restart_count_once(spark, tmp_path):
    """Batches of 70, 0 and 80 rows: the second window is cut, each batch comes twice, and the last one after a commit was lost."""
    rows = spark.range(150).select("id", F.timestamp_seconds("id").alias("ts"), ((F.col("id") * 7) % 10 / 10).alias("score"))
    parts = [rows.filter("id < 70"), rows.filter("id < 0"), rows.filter("id >= 70")]
    table = str(tmp_path / "t")
    job = J.CountWindows([0.5], 50, table)
    for n, part in enumerate(parts):
        for _ in range(2):
            job(part, n)
    counts = lambda: {(r.window, r.bin): r.n for r in spark.read.parquet(table).filter("window is not null").groupBy("window", "bin").agg(F.sum("n").alias("n")).collect()}
    want = {(w, b): 25 for w in range(3) for b in range(2)}
    assert counts() == want
    assert {(r.window, r.psi) for r in J.count_window_psi(spark, table, 50, [0.5, 0.5]).collect()} == {(0, 0.0), (1, 0.0), (2, 0.0)}
    for i, part in enumerate([parts[0], parts[2]]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        J.count_window_counts(stream, [0.5], 50, f"{tmp_path}/s", f"{tmp_path}/state")
    last = max((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    J.count_window_counts(stream, [0.5], 50, f"{tmp_path}/s", f"{tmp_path}/state")  # the last batch runs again
    table = f"{tmp_path}/s"
    assert counts() == want
    J.count_window_counts(stream, [0.5], 50, f"{tmp_path}/s", f"{tmp_path}/state")  # nothing new
    assert counts() == want


def test_promoted_models_serve_from_the_next_batch(spark, tmp_path):
    """Each row is judged as its version judges it in batch; the version changes between two batches, and a model is loaded once."""
    from trafficwarden.plans.stream_queries import fitted_stages

    rows = tagged(spark, DATA).select("id", "ts", "query_raw", "label").filter("id < 400").cache()
    models = {"1.0": fitted_stages(rows.filter("label < 5"), "isolation_forest"), "2.0": fitted_stages(rows, "isolation_forest")}
    asked, loaded = [], []

    def active():
        asked.append(1)
        return "1.0" if len(asked) < 3 else "2.0"

    for i in range(4):
        rows.filter(F.floor(F.col("id") / 100) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = J.ModelVerdicts(active, lambda v: loaded.append(v) or models[v], f"{tmp_path}/out")
    job.run_to_end(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch").cache()
    assert loaded == ["1.0", "2.0"] and {(r.version, r.n) for r in got.groupBy("version").agg(F.count("*").alias("n")).collect()} == {("1.0", 200), ("2.0", 200)}
    for version in models:
        part = got.filter(F.col("version") == version)
        want = job.judged(rows.join(part.select("id"), "id", "left_semi"), version)
        assert {tuple(r) for r in part.collect()} == {tuple(r) for r in want.collect()}
    assert "stacked" not in {r.predicted for r in got.filter("version = '1.0'").collect()} and "stacked" in {r.predicted for r in got.filter("version = '2.0'").collect()}


def _stream(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).parquet(f"{path}/in")


def test_triggers(spark, tmp_path):
    s = _stream(spark, tmp_path / "a", [[(w, "global", v) for w, v in enumerate([0.1, 0.3, 0.1, 0.3, 0.4, 0.5])]], "window long, signal string, psi double")
    J.run_to_end(J.sustained_breaches(s), f"{tmp_path}/a/out", f"{tmp_path}/a/s")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/a/out").collect()] == [("global", 4)]
    s = _stream(spark, tmp_path / "b", [[("r1", i) for i in range(7)] + [("r2", 1)]], "round_id string, id long")
    J.run_to_end(J.retrain_triggers(s, 5), f"{tmp_path}/b/out", f"{tmp_path}/b/s")
    assert [r.round_id for r in spark.read.parquet(f"{tmp_path}/b/out").collect()] == ["r1"]


def test_holds_time_out(spark, tmp_path):
    at = lambda m: F.to_timestamp(F.lit(f"2024-01-01 00:{m:02d}:00"))
    rows = [(1, 0, "hold"), (1, 2, "approved"), (2, 0, "hold"), (3, 40, "hold")]
    schema = "id long, ts timestamp, kind string"
    for i, (k, m, kind) in enumerate(rows):
        spark.range(1).select(F.lit(k).cast("long").alias("id"), at(m).alias("ts"), F.lit(kind).alias("kind")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    J.run_to_end(J.hold_timeouts(s), f"{tmp_path}/out", f"{tmp_path}/s")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "approved"), (2, "deny")}


def test_late_windows_take_their_place(spark, tmp_path):
    """Against a plain loop over the sorted windows; three restarts from the checkpoint, and a bounded state."""
    rng = np.random.default_rng(5)
    values = {(sig, w): float(rng.random()) for sig in ("a", "b", "c") for w in range(40)}
    order = sorted(values, key=lambda k: k[1] + 3 * rng.random())  # a window is late by less than 4
    order += [("c", 0), ("c", 5), ("a", 60), ("b", 60), ("c", 60)]
    want = set()
    for sig in "abc":
        run = 0
        for w in range(40):
            run = run + 1 if values[sig, w] >= 0.4 else 0
            if run == 3:
                want.add((sig, w))
                break
    schema = "window long, signal string, psi double"
    for i in range(3):
        part = [(w, sig, values.get((sig, w), 0.0)) for sig, w in order[i * len(order) // 3 : (i + 1) * len(order) // 3]]
        spark.createDataFrame([*part, (None, "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        J.run_to_end(J.sustained_breaches(s, 0.4, 3, wait=4), f"{tmp_path}/out", f"{tmp_path}/state")
    assert len(want) == 3 and {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "settled").load()
    assert held.count() == 3


def test_holds_against_a_loop(spark, tmp_path):
    """Decisions before, after and without a hold, in files that come in time order; each id once."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(200):
        hold, decision = int(rng.integers(0, 3600)), int(rng.integers(-100, 600))
        if k % 4 != 1:
            rows.append((k, hold, "hold"))
        if k % 4 != 2:
            rows.append((k, max(hold + decision, 0), "approved"))
        decided = max(hold + decision, 0)
        if k % 4 == 1:
            want[k] = "approved"
        elif k % 4 == 2:
            want[k] = "deny"
        else:
            want[k] = "deny" if decided > hold + 300 else "approved"
    rows.append((-1, 90_000, "hold"))
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows), 120):
        part = spark.createDataFrame([(k, t, kind) for k, t, kind in rows[i : i + 120]], "id long, t long, kind string")
        part.select("id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id long, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    J.run_to_end(J.hold_timeouts(s), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(want) and dict(got) == want


def test_stream_files_arrive_in_time_order(spark, tmp_path, monkeypatch):
    """Where the earliest range is slow to write, later ones still come after it, and no row is dropped as late."""
    from trafficwarden.plans import stream_queries as Q

    span = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600)
    heavy = F.when(F.col("id") < 500, F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(3_000)), lambda i: F.sha2(F.concat_ws(",", i, "id"), 256)))).otherwise(F.lit("x"))
    rows = spark.range(2000).select("id", span.alias("ts"), (F.col("id") % 3).alias("client"), heavy.alias("query_raw"), F.lit(False).alias("is_attack"), F.lit("normal").alias("predicted"), F.lit(0.9).alias("confidence"), F.lit(0.1).alias("score"), F.lit("normal").alias("label_name"))
    monkeypatch.setattr(Q, "_rows", lambda s, d: rows)
    made = Q._folder(spark)
    monkeypatch.setattr(Q, "_folder", lambda s: made)
    assert Q.streamed(J.once)(spark, "").count() == 2000
    spans = spark.read.parquet(f"{made}/in").select("ts", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")).groupBy("file", "at").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("low").collect()
    assert all(a.at < b.at and a.high < b.low for a, b in zip(spans, spans[1:]))
    light = rows.withColumn("query_raw", F.lit("x"))
    assert len(spark.read.parquet(Q.in_order(light, f"{made}/more", per_file=300)).inputFiles()) == 7


def test_registered_comparisons_are_whole(spark, monkeypatch):
    """The queries leave out no candidate or detector, and fit with the operator's own vocabulary and iterations."""
    from trafficwarden.plans import model_queries as Q

    d, asked = "/root/testdata/sf0.001", []
    compared = Q.QUERIES["ml4_compare_classifiers"](spark, d).collect()
    assert {r.candidate for r in compared} == set(ML.candidates()) and len({sum(r.confusion.values()) for r in compared}) == 1
    assert all(r.f1_macro > 0.9 and len(r.f1_by_class) == 6 and r.p50_ms <= r.p95_ms and r.size_bytes > 10_000 for r in compared)
    assert {r.detector for r in Q.QUERIES["ml11_compare_detectors"](spark, d).collect()} == set(Q.DETECTORS)
    fit = ML.fit_classifier
    monkeypatch.setattr(ML, "fit_classifier", lambda df, **options: asked.append(options) or fit(df, **options))
    assert Q.QUERIES["ml2_ml3_classify"](spark, d).count() > 0 and asked == [{}]
