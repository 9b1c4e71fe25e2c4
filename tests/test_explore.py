"""Search over sets of features against single fits and plain formulas."""

import numpy as np
from pyspark.sql import functions as F

from trafficwarden.operators import explore as P
from trafficwarden.operators import models as ML


def test_sets():
    sets = P.feature_sets()
    assert len(sets) == 70 and sets["baseline_4"] == P.BASE and sets["baseline_4+all_new"] == [*P.BASE, *P.CANDIDATES]
    assert sets["subset[]+bigram_entropy"] == ["bigram_entropy"] and sum(len(v) for v in sets.values()) == 4 + 4 * 5 + 8 + 4 * (16 + 32)


def test_fits_are_those_of_single_detectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 3))
    masks = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 0]], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    got = {r.id: r.scores for r in P.svms_scores(df, P.fit_svms(df, masks)).collect()}
    for no, mask in enumerate(masks):
        hidden = spark.createDataFrame([(i, (v * mask).tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        want = {r.id: r.anomaly_score for r in ML.svm_scores(hidden, ML.fit_svm(hidden)).collect()}
        assert max(abs(got[i][no] - want[i]) for i in want) < 1e-5


def test_measures_of_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"a": (400, 0.5), "b": (30, 0.0), "c": (5, 3.0)}
    rows = [(g, float(np.round(rng.normal() + shift * pos, 1)), bool(pos)) for g, (n, shift) in groups.items() for pos in (0, 1) for _ in range(n)]
    more = [("a", None, True), (None, 1.0, True), ("lone", 1.0, True), ("lone", 2.0, True)]
    df = spark.createDataFrame(rows + more, "g string, s double, y boolean")
    got = {r.g: r for r in P.curves(df, "g", "s", F.col("y")).collect()}
    assert set(got) == {"a", "b", "c", "lone"} and got["lone"].auc is None and got["lone"].ks is None
    rates = {r.g: r for r in P.matched(df, "g", "s", F.col("y")).collect()}
    for g in groups:
        pos, neg = (np.array([s for h, s, y in rows if h == g and y == k]) for k in (True, False))
        auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
        points = np.unique(np.concatenate([pos, neg]))
        ks = max(abs((pos <= t).mean() - (neg <= t).mean()) for t in points)
        limit = np.percentile(neg, 95)
        assert abs(got[g].auc - auc) < 1e-5 and abs(got[g].ks - ks) < 1e-5
        assert abs(rates[g].threshold - limit) < 1e-5 and abs(rates[g].fpr - (neg > limit).mean()) < 1e-5 and abs(rates[g].detection_rate - (pos > limit).mean()) < 1e-5
    assert "lone" not in rates and P.curves(df.limit(0), "g", "s", F.col("y")).count() == 0


def test_search_finds_the_telling_feature(spark):
    rng = np.random.default_rng(3)
    make = lambda n, shift: [(float(a), float(b + shift), float(c)) for a, b, c in rng.standard_normal((n, 3))]
    names = "plain double, telling double, noise double"
    train = spark.createDataFrame(make(600, 0), names)
    tested = spark.createDataFrame(make(300, 0), names).withColumn("y", F.lit(False)).unionByName(spark.createDataFrame(make(300, 5), names).withColumn("y", F.lit(True)))
    sets = P.feature_sets(["plain"], ["telling", "noise"])
    got = {r.name: r for r in P.explore(train, tested, F.col("y"), sets).collect()}
    assert set(got) == set(sets) and got["subset[]+telling"].auc > 0.95 and got["subset[]+noise"].auc < 0.65
    assert all(abs(r.fpr - 0.05) < 0.005 for r in got.values())
    assert P.explore(train, tested.limit(0), F.col("y"), sets).count() == 0
