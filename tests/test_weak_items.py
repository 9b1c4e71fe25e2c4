"""Zero-day rows, empty windows, cleaned pools, importance of a fitted detector and timings, by hand-worked values."""

import numpy as np
from pyspark.sql import functions as F

from trafficwarden.operators import drift as R
from trafficwarden.operators import metrics as E
from trafficwarden.operators import models as M


def test_zero_day_predictions(spark):
    rows = [("stacked", "normal", 0.9), ("stacked", "union_based", 0.1), ("stacked", "union_based", None), ("stacked", None, 0.9), ("normal", "stacked", 0.9)]
    r = E.zero_day(spark.createDataFrame(rows, "y string, p string, s double"), "y", "p", F.col("s") > 0.5).collect()
    assert len(r) == 1 and (r[0].n, r[0].miss_rate, r[0].detection_rate, r[0].covered) == (4, 0.25, 0.5, 1.0)
    assert r[0].predictions == {"normal": 1, "union_based": 2, "none": 1}


def test_empty_windows_have_equal_shares(spark):
    edges = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [])], "feature string, edges array<double>")
    df = spark.createDataFrame([(0, "a", 0.5), (0, "a", 1.0), (0, "a", 1.5), (0, "a", 9.0), (1, "a", None), (1, "b", 3.0), (None, "b", 1.0)], "w int, feature string, x double")
    frame = spark.createDataFrame([(0,), (1,), (1,), (2,), (None,)], "w int")
    got = {(r.w, r.feature): (r.n, [round(c, 6) for c in r.cur]) for r in R.fractions_of_all(df, edges, frame, ["w"]).collect()}
    third = [0.333333] * 3
    assert got == {(0, "a"): (4, [0.25, 0.5, 0.25]), (1, "a"): (0, third), (2, "a"): (0, third), (None, "a"): (0, third), (0, "b"): (0, [1.0]), (1, "b"): (1, [1.0]), (2, "b"): (0, [1.0]), (None, "b"): (1, [1.0])}
    assert R.fractions_of_all(df, edges, frame.limit(0), ["w"]).count() == 0


def made(spark):
    rng = np.random.default_rng(4)
    make = lambda at, n, shift, y: [(at + i, float(a + shift), float(b), y) for i, (a, b) in enumerate(rng.standard_normal((n, 2)))]
    of = lambda rows: spark.createDataFrame(rows, "id long, telling double, noise double, y boolean")
    return of(make(0, 600, 0, False)), of(make(5000, 150, 6, True)), of(make(0, 300, 0, False) + make(7000, 300, 6, True))


def test_pool_impact(spark):
    clean, leak, tested = made(spark)
    got = {r.pool: r for r in M.pool_impact(clean.unionByName(leak), F.col("y"), tested, ["telling", "noise"], F.col("y"), threshold=0.6).collect()}
    assert (got["current"].train_rows, got["current"].leaked_rows, got["cleaned"].train_rows, got["cleaned"].leaked_rows) == (750, 150, 600, 0)
    assert got["cleaned"].detection_rate > got["current"].detection_rate and got["current"].leaked_flagged is not None and got["cleaned"].leaked_flagged is None
    for m in ("fpr", "detection_rate", "p50", "p90", "p99", "largest", "mean"):
        assert abs(got["difference"][m] - (got["cleaned"][m] - got["current"][m])) < 1e-9
    none = {r.pool: r for r in M.pool_impact(clean, F.lit(None).cast("boolean"), tested, ["telling", "noise"], F.col("y"), threshold=0.6).collect()}
    assert none["current"].leaked_flagged is None and none["difference"].fpr == 0 and none["difference"].p90 == 0


def test_detector_importance(spark):
    clean, _, tested = made(spark)
    got = {r.feature: r["drop"] for r in M.detector_importance(clean, tested, ["telling", "noise"], F.col("y")).collect()}
    assert got["telling"] > 0.2 > got["noise"] + 0.1
    shuffled = E.permuted(tested.withColumn("k", F.monotonically_increasing_id()), "telling", "k", 0)
    assert sorted(r.telling for r in shuffled.collect()) == sorted(r.telling for r in tested.collect())


def test_scoring_times(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def touched(i):
        seen.add(1)
        return i

    df = spark.range(500).withColumn("text", F.lit("x"))
    got = E.scoring_times(lambda d: d.withColumn("p", touched("id")), df, "id", 4).collect()
    assert sum(r.rows for r in got) == 500 and seen.value == 500 and all(r.seconds > 0 for r in got)
    assert E.scoring_times(lambda d: d, df.limit(0), "id").count() == 0
