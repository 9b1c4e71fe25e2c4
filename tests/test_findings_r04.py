"""Findings of round 4: each test failed before its finding was mended."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trafficwarden.operators import grams as G
from trafficwarden.operators import models as ML


def _plain(text):
    return [f" {w} "[i : i + n] for w in re.split("[\t-\r \x85\xa0 ]+", text or "") if w for n in (2, 3, 4) for i in range(len(w) + 3 - n)]


@pytest.mark.parametrize("ids, size", [(G.MOST_IDS, 1 << 18), (4, 300), (G.MOST_IDS, 50)])
def test_grams_of_batches_are_those_of_each_text(monkeypatch, ids, size):
    """N-grams were counted and looked up a text at a time."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c\t  \x85é\x00Z\U0001f600'") for _ in range(rng.randrange(14))) for _ in range(500)] + ["", " ", "a"]
    weights = np.array([rng.randrange(1, 4) for _ in texts])
    places, held = Counter(), Counter()
    for t, n in zip(texts, weights.tolist()):
        for g, c in Counter(_plain(t)).items():
            places[g] += c * n
            held[g] += n
    monkeypatch.setattr(G, "CHARACTERS", size)
    monkeypatch.setattr(G, "MOST_IDS", ids)
    got = [Counter(), Counter()]
    for found, h, p in G.counted(texts, weights):
        for g, a, b in zip(found, p.tolist(), h.tolist()):
            got[0][g] += a
            got[1][g] += b
    assert got == [places, held]
    monkeypatch.setattr(G, "MOST_IDS", 65535)
    vocabulary = [g for g, _ in places.most_common(200)]
    scale = np.array([1 + rng.random() for _ in vocabulary])
    number, row = {g: i for i, g in enumerate(vocabulary)}, 0
    for n, ends, at, value in G.GramWeights(vocabulary, scale).rows([*texts, None]):
        for begin, end in zip(np.append(0, ends[:-1]), ends):
            want = {number[g]: c * scale[number[g]] for g, c in Counter(_plain([*texts, None][row])).items() if g in number}
            length = sum(v * v for v in want.values()) ** 0.5
            assert at[begin:end].tolist() == sorted(want)
            assert value[begin:end] == pytest.approx([want[k] / length for k in sorted(want)])
            row += 1
    assert row == len(texts) + 1


def test_scores_of_batches_are_those_of_the_stages(spark, monkeypatch):
    """A vector was made of each scored text by the stages one after the other."""
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([("select a from b", 0), ("x' or 1=1 --", 3), ("union all select 1", 1), ("sleep(5)", 4), ("", 0), (None, 3), ("é zoë", 0)] * 3)], "id int, query_canonical string, label int")
    model = ML.fit_classifier(rows, vocabulary=100)
    got = {r.id: r for r in ML.classify(model, rows).collect()}
    for r in model.transform(ML.with_grams(rows)).withColumn("p", vector_to_array("probability")).collect():
        assert [got[r.id].probabilities[n] for n in ML.LABELS[: len(r.p)]] == pytest.approx(r.p, abs=1e-9)
        assert got[r.id].predicted == ML.LABELS[int(r.prediction)] and got[r.id].attack_prob == pytest.approx(1 - r.p[0], abs=1e-6)
    ours = {r.id: r.v for r in ML.with_tfidf(model, rows).select("id", vector_to_array("tfidf").alias("v")).collect()}
    for r in PipelineModel(model.stages[:3]).transform(ML.with_grams(rows)).select("id", vector_to_array("tfidf").alias("v")).collect():
        assert ours[r.id] == pytest.approx(r.v, abs=1e-12)
    monkeypatch.setattr(ML, "with_grams", lambda *a: pytest.fail("found one by one"))
    ML.classify(model, rows)


def test_held_out_classes_share_counted_rows(spark, monkeypatch):
    """F2: training rows were counted, and tested rows scored, once more for each held-out class; copies of an id count as the joins count them."""
    seen, asked, counted, classify = [], [], ML.counted_rows, ML.classify
    monkeypatch.setattr(ML, "counted_rows", lambda df, *a: seen.append(1) or counted(df, *a))
    monkeypatch.setattr(ML, "classify", lambda m, df, *a: asked.append(df.count()) or classify(m, df, *a))
    texts = [("select a from b", 0, "normal"), ("x' or 1=1", 3, "boolean_blind"), ("union all select 1", 1, "union_based"), ("union x", 1, "union_based")]
    rows = spark.createDataFrame([(i, *texts[i % 4]) for i in range(40)], "id long, query_canonical string, label int, label_name string")
    test = rows.unionByName(rows.filter("id < 4"))  # four ids come twice
    scores = spark.createDataFrame([(i, 1.0 if i % 8 < 4 else 0.0) for i in range(36)] + [(1, 1.0)], "id long, anomaly_score double")
    got = {r.label_name: r for r in ML.zero_day_runs(rows, test, "label", [1, 3], scores, threshold=0.5, vocabulary=100).collect()}
    assert len(seen) == 1 and asked == [4, 4]
    joined = test.join(scores, "id", "left")
    for name, c in (("union_based", 1), ("boolean_blind", 3)):
        n, flagged = joined.filter(F.col("label") == c).agg(F.count("*"), F.count_if(F.col("anomaly_score") > 0.5)).first()
        assert got[name].n == n and got[name].detection_rate == round(flagged / n, 6) and sum(got[name].predictions.values()) == n and got[name].f1_macro == 1.0


def test_arms_count_their_rows_once(spark, monkeypatch):
    """the base rows were counted once more for each arm, and the control met in the one task of a sort with a limit."""
    from trafficwarden.operators import curate as C
    from trafficwarden.plans import workflow as Y

    seen, counted = [], ML.counted_rows
    monkeypatch.setattr(ML, "counted_rows", lambda df, *a: seen.append(df.count()) or counted(df, *a))
    base = spark.createDataFrame([(i, f"select {i % 3} from b" if i % 2 else f"{i % 3}' or 1=1", 0 if i % 2 else 3) for i in range(200)], "id long, query_canonical string, label int")
    fresh = spark.createDataFrame([(1000 + i, f"; drop table t{i % 5}", 5) for i in range(20)], "id long, query_canonical string, label int")
    got = {r.arm: r for r in Y.ablation_arms(base, fresh, base.unionByName(fresh), {"vocabulary": 200, "iterations": 20}).collect()}
    assert seen == [200, 20, 20, 20, 2] and [got[n].rows for n in ("champion", "naive", "balanced", "volume_control", "starved")] == [200, 220, 220, 220, 22]
    assert got["naive"].new_recall == 1.0 and got["volume_control"].new_recall == 0.0
    want = base.withColumn("_h", C.sample_key("id", 7)).orderBy("_h", "id").limit(20)
    some = C.reservoir(base, "id", 20, 7)
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in want.collect())
    assert "Limit" not in some._jdf.queryExecution().toString()


def test_perceptron_takes_equal_rows_once_and_keeps_them_sparse(spark, monkeypatch):
    """the perceptron kept each row as 16 KB, most of it zeros, copies too."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from trafficwarden.operators import perceptron as N

    texts = [("select a from b", 0, 30), ("select c from b", 0, 7), ("x' or 1=1", 3, 20), ("union all select 1", 1, 9), ("; drop table x", 5, 4), ("", 0, 3), ("sleep(4)", 4, 6), ("extractvalue(1)", 2, 5)]
    rows = spark.createDataFrame([(t, y) for t, y, n in texts for _ in range(n)], "query_canonical string, label int")
    asked = spark.createDataFrame([(t, ML.LABELS[y]) for t, y, _ in texts], "query_canonical string, y string").coalesce(1)
    sparse, seen = N._sparse, []
    monkeypatch.setattr(N, "_sparse", lambda df, *a: seen.append(df.count()) or sparse(df, *a))
    model = ML.fit_classifier(rows, vocabulary=100, estimator=ML.candidates()["perceptron"])
    assert seen == [8] and ML.classify(model, asked).filter("predicted <> y").count() == 0
    # the library's fit from the same first weights ends near the same loss
    vectors = ML.with_tfidf(model, rows).withColumn("_y", F.col("label").cast("double"))
    library = MultilayerPerceptronClassifier(maxIter=50, seed=1, featuresCol="tfidf", labelCol="_y", layers=list(model.stages[3].getLayers())).fit(vectors)
    loss = lambda m: m.transform(vectors).select((-F.log(F.greatest(vector_to_array("probability")[F.col("label")], F.lit(1e-9)))).alias("l")).agg(F.avg("l")).first()[0]
    assert loss(model.stages[3]) <= loss(library) + 0.01
    # the gradient is that of the loss
    rng, layers = np.random.default_rng(2), [5, 3, 4]
    w, x, y, n = rng.standard_normal(34), rng.standard_normal((6, 5)), rng.integers(0, 4, 6), rng.integers(1, 4, 6).astype(float)
    g, _ = N.gradient(w, layers, x, y, n)
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        assert g[i] == pytest.approx((N.gradient(w + e, layers, x, y, n)[1] - N.gradient(w - e, layers, x, y, n)[1]) / 2e-6, abs=1e-5)


def test_steps_of_sessions_get_only_the_features_of_the_detector(spark, monkeypatch):
    """All twelve features were found and written for each step, where the detector has two."""
    from trafficwarden.functions import features as X
    from trafficwarden.operators import estimators as E

    rng = random.Random(2)
    rows = spark.createDataFrame([(f"s{i % 9}", i, f"select {'x' * rng.randrange(30)} from b{'(' * rng.randrange(4)}") for i in range(60)], "session_id string, step_index int, query_canonical string")
    wide = X.with_features(rows)
    detector = E.AnomalyDetector(features=["length", "special_char_ratio"]).fit(wide)
    want = {r.step_index: r.anomaly_score for r in detector.transform(wide).collect()}
    seen, transform = [], E.AnomalyDetectorModel._transform
    monkeypatch.setattr(E.AnomalyDetectorModel, "_transform", lambda self, df: seen.append(df.columns) or transform(self, df))
    got = E.SessionCorrelatorModel(None, detector)._scored(rows, detector)
    assert {r.step_index: r.score for r in got.collect()} == want
    assert seen == [["session_id", "step_index", "query_canonical", "length", "special_char_ratio"]]
