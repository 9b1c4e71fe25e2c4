"""Population drift: stability indices of windows against reference bins, and sustained-breach triggers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.operators.order import quantiles

FLOOR = 1e-6
#: The signals of a window, by priority of their triggers.
SIGNALS = ["global", "attack_subpop", "prediction", "confidence", "confidence_flagged"]


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep columns, feature, x."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")).select(*keep, "p.feature", "p.x")


def bin_of(x: Column, edges: Column) -> Column:
    """Number of inner edges at or below x: bin i is [edge i, edge i + 1), the outer ones open."""
    return F.size(F.filter(edges, lambda e: e <= x))


def fit_reference(df: DataFrame, bins: int = 10, by: str = "feature", x: str = "x") -> DataFrame:
    """feature, edges (inner edges of the distinct quantiles), ref (share of each bin). A constant feature has one bin; a feature without values has no row."""
    cuts = quantiles(df, [by], x, [i / bins for i in range(bins + 1)])
    distinct = F.array_sort(F.array_distinct("q"))
    inner = F.when(F.size(distinct) > 2, F.slice(distinct, 2, F.size(distinct) - 2)).otherwise(F.array().cast("array<double>"))
    edges = cuts.select(by, inner.alias("edges"))
    shares = fractions(df, edges, [], by, x)
    return edges.join(shares.withColumnRenamed("cur", "ref"), by)


def fractions(df: DataFrame, edges: DataFrame, windows: list[str], by: str = "feature", x: str = "x") -> DataFrame:
    """windows, feature, n, cur: share of each bin, zeros included. A row of bins for each feature is broadcast."""
    placed = df.filter(F.col(x).isNotNull()).join(F.broadcast(edges.select(by, "edges")), by).select(*windows, by, (F.size("edges") + 1).alias("bins"), bin_of(F.col(x), F.col("edges")).alias("bin"))
    counts = placed.groupBy(*windows, by, "bins", "bin").agg(F.count("*").alias("c"))
    # at most bins rows a group meet
    whole = counts.groupBy(*windows, by, "bins").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    share = F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("n"))
    return whole.select(*windows, by, "n", share.alias("cur"))


def fractions_of_all(df: DataFrame, edges: DataFrame, frame: DataFrame, windows: list[str], by: str = "feature", x: str = "x") -> DataFrame:
    """fractions of every window of the frame (a row a window): one without a value of a feature has n 0 and equal shares."""
    every = frame.select(*windows).distinct().join(F.broadcast(edges.select(by, F.size("edges").alias("_inner"))))  # a row a feature
    found = fractions(df, edges, windows, by, x)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*windows, by)]
    equal = F.transform(F.sequence(F.lit(0), F.col("_inner")), lambda _: F.lit(1.0) / (F.col("_inner") + 1))
    return every.alias("a").join(found.alias("b"), same, "left").select(*[f"a.{c}" for c in (*windows, by)], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cur", equal).alias("cur"))


def psi_of(cur: Column, ref: Column) -> Column:
    """Sum over bins of (cur - ref) ln(cur / ref), shares floored."""
    return _sum_bins(cur, ref, lambda c, r: (c - r) * F.ln(c / r))


def kl_of(cur: Column, ref: Column) -> Column:
    """Sum over bins of cur ln(cur / ref), shares floored."""
    return _sum_bins(cur, ref, lambda c, r: c * F.ln(c / r))


def _sum_bins(cur: Column, ref: Column, term) -> Column:
    floored = lambda v: F.greatest(v, F.lit(FLOOR))
    return F.aggregate(F.zip_with(cur, ref, lambda c, r: term(floored(c), floored(r))), F.lit(0.0), lambda a, b: a + b)


def psi(df: DataFrame, reference: DataFrame, windows: list[str], by: str = "feature", x: str = "x", metric: str = "psi", digits: int | None = 6) -> DataFrame:
    """windows, feature, n, psi of each window against the reference. Windows without values have no row."""
    value = (psi_of if metric == "psi" else kl_of)(F.col("cur"), F.col("ref"))
    value = value if digits is None else F.round(value, digits)
    placed = fractions(df, reference, windows, by, x).join(F.broadcast(reference.select(by, "ref")), by)
    return placed.select(*windows, by, "n", value.alias(metric))


def shares(df: DataFrame, windows: list[str], label: str) -> DataFrame:
    counts = df.groupBy(*windows, label).agg(F.count("*").alias("c"))
    whole = W.partitionBy(*windows) if windows else W.partitionBy(F.lit(0))
    return counts.select(*windows, label, (F.col("c") / F.sum("c").over(whole)).alias("share"))


def psi_categorical(current: DataFrame, reference: DataFrame, windows: list[str], label: str) -> DataFrame:
    """windows, psi over the labels of either side; current and reference are tables of shares."""
    keys = current.select(*windows).distinct()
    wanted = keys.join(F.broadcast(reference.select(label))) if windows else reference.select(label)  # classes are few
    grid = wanted.unionByName(current.select(*windows, label)).distinct()
    both = grid.join(current, [*windows, label], "left").join(F.broadcast(reference.withColumnRenamed("share", "ref")), label, "left")
    c, r = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(FLOOR)), F.greatest(F.coalesce("ref", F.lit(0.0)), F.lit(FLOOR))
    return both.groupBy(*windows).agg(F.round(F.sum((c - r) * F.ln(c / r)), 6).alias("psi"))


def band(value: Column, threshold: float = 0.2) -> Column:
    return F.when(value < 0.1, "stable").when(value < threshold, "moderate").otherwise("significant")


def count_window(position: str, size: int) -> Column:
    """Number of the window of so many rows that a position is in."""
    return F.floor(F.col(position) / size)


def replay(stream: DataFrame, features: list[str], size: int, baseline: int, bins: int = 10, threshold: float = 0.2, least: int = 5) -> DataFrame:
    """A row for each window of the stream: window, phase, is_reference, n, the five signals, rates, alert.

    stream has position, phase, predicted, confidence and the features. The first ``baseline`` windows
    are the reference. Signals of flagged rows need ``least`` of them in the window, else they are 0;
    their reference needs ``bins`` flagged rows (else attack_subpop is 0, and confidence_flagged
    is measured against all rows).
    """
    flagged = F.col("predicted") != "normal"
    rows = stream.withColumn("window", count_window("position", size))
    is_ref = F.col("position") < baseline * size
    ref, keep = rows.filter(is_ref), ["window"]
    names = list(dict.fromkeys([*features, "confidence"]))

    # one table of series: all rows, flagged rows, and flagged rows against the bins of all rows
    def series(df: DataFrame, mixed: Column) -> DataFrame:
        each = lambda kind, f, on: F.struct(F.lit(f"{kind}/{f}").alias("feature"), F.when(on, F.col(f).cast("double")).alias("x"))
        of = [each("all", f, F.lit(True)) for f in names] + [each("hit", f, flagged) for f in names] + [each("mix", "confidence", mixed)]
        return df.select("window", F.explode(F.array(*of)).alias("p")).select("window", "p.feature", "p.x")

    found = psi(series(rows, flagged), fit_reference(series(ref, F.lit(True)), bins), keep, digits=None)
    mean = lambda kind, of: F.mean(F.when(F.col("feature").isin([f"{kind}/{f}" for f in of]), F.col("psi")))
    means = found.groupBy("window").agg(
        mean("all", features).alias("global"), mean("hit", features).alias("attack_subpop"), mean("all", ["confidence"]).alias("confidence"),
        mean("hit", ["confidence"]).alias("own"), mean("mix", ["confidence"]).alias("other"))
    refs = ref.agg(F.count_if(flagged).alias("ref_flagged"))  # one row
    # a mean of doubles depends on their order: each window is added up from its first row to its last
    ordered = rows.select("window", "position", "phase", "predicted", "confidence").repartition("window").sortWithinPartitions("window", "position")
    base = ordered.groupBy("window").agg(F.min("phase").alias("phase"), F.count("*").alias("n"), F.count_if(flagged).alias("flagged"), F.round(F.mean(flagged.cast("double")), 6).alias("block"), F.round(F.mean((F.col("confidence") < 0.6).cast("double")), 6).alias("low_confidence"), F.round(F.mean("confidence"), 6).alias("mean_confidence"), F.max("position").alias("last"))
    out = base.join(F.broadcast(refs))
    out = out.join(means, "window", "left")
    out = out.join(psi_categorical(shares(rows, keep, "predicted"), shares(ref, [], "predicted"), keep, "predicted").withColumnRenamed("psi", "prediction"), "window", "left")
    enough, fitted = F.col("flagged") >= least, F.col("ref_flagged") >= bins
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = out.withColumns({
        "global": zero(F.col("global")), "attack_subpop": zero(F.when(enough & fitted, F.col("attack_subpop"))), "prediction": zero(F.col("prediction")), "confidence": zero(F.col("confidence")),
        "confidence_flagged": zero(F.when(enough, F.when(fitted, F.col("own")).otherwise(F.col("other")))),
    })
    alert = F.greatest(*[F.col(s) for s in SIGNALS]) >= threshold
    return out.select("window", "phase", (F.col("last") < baseline * size).alias("is_reference"), "n", *SIGNALS, "block", "low_confidence", "mean_confidence", alert.alias("alert"))


def as_maps(windows: DataFrame) -> DataFrame:
    """Signals and rates of windows as maps psi and rates."""
    pack = lambda names: F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(n)) for n in names]))
    return windows.select("window", "phase", "is_reference", "n", pack(SIGNALS).alias("psi"), pack(["block", "low_confidence", "mean_confidence"]).alias("rates"), "alert")


def phase_summary(windows: DataFrame, threshold: float = 0.2) -> DataFrame:
    """signal, mean and max in phase A (reference windows left out) and B, quiet_in_a, fired_in_b, ratio."""
    long = windows.select("phase", "is_reference", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in SIGNALS])).alias("p")).select("phase", "is_reference", "p.*")
    a, b = (F.col("phase") == "A") & ~F.col("is_reference"), F.col("phase") == "B"
    r = lambda c: F.round(c, 6)
    out = long.groupBy("signal").agg(r(F.mean(F.when(a, F.col("v")))).alias("mean_a"), r(F.max(F.when(a, F.col("v")))).alias("max_a"), r(F.mean(F.when(b, F.col("v")))).alias("mean_b"), r(F.max(F.when(b, F.col("v")))).alias("max_b"))
    return out.select("*", F.coalesce(F.col("max_a") < threshold, F.lit(True)).alias("quiet_in_a"), F.coalesce(F.col("max_b") >= threshold, F.lit(False)).alias("fired_in_b"), r(F.col("mean_b") / F.nullif(F.col("mean_a"), F.lit(0.0))).alias("ratio"))


def trigger(windows: DataFrame, threshold: float = 0.2, sustained: int = 2, signals: list[str] | None = None) -> DataFrame:
    """One row: fired, window_index, signal: the first window that ends so many breaches in a row; earlier signals win ties."""
    names = signals or SIGNALS
    long = windows.select("window", F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(s).alias("signal"), (F.col(s) >= threshold).alias("breach")) for i, s in enumerate(names)])).alias("p")).select("window", "p.*")
    span = W.partitionBy("priority").orderBy("window").rowsBetween(1 - sustained, 0)
    hits = long.withColumn("run", F.count_if("breach").over(span)).filter(F.col("run") == sustained)
    first = hits.agg(F.min(F.struct("window", "priority", "signal")).alias("f"))
    return first.select(F.col("f").isNotNull().alias("fired"), F.col("f.window").alias("window_index"), F.col("f.signal").alias("signal"))


def strongest(windows: DataFrame) -> DataFrame:
    """For a monitor: window, phase, is_reference, the strongest signal and its value."""
    best = F.array_max(F.array(*[F.struct(F.col(s).alias("value"), F.lit(-i).alias("priority"), F.lit(s).alias("signal")) for i, s in enumerate(SIGNALS)]))
    return windows.select("window", "phase", "is_reference", best.alias("b")).select("window", "phase", "is_reference", "b.signal", "b.value")
