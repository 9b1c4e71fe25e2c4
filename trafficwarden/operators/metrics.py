"""Classification and detector metrics. Curves are cumulative counts over distinct scores, so tables of
scores are aggregated before anything is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.operators.order import kept, quantiles, running_sums, with_position


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, truth: str = "label_name", predicted: str = "predicted", rows: str | None = None) -> DataFrame:
    """truth, predicted, n of the pairs that occur. With rows each row counts as often as that column says."""
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg((F.sum(rows) if rows else F.count("*")).alias("n"))


def class_report(cells: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support over the labels of truth or prediction, from a confusion table."""
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "called")])
    p, r = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support")


def summary(cells: DataFrame) -> DataFrame:
    """One row: accuracy, f1_macro over all labels of truth or prediction, n."""
    macro = class_report(cells).agg(F.round(F.mean("f1"), 6).alias("f1_macro"))
    whole = cells.agg(F.round(_ratio(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")), 6).alias("accuracy"), F.sum("n").alias("n"))
    return whole.join(F.broadcast(macro))  # one-row tables


def gate_evaluation(cells: DataFrame, normal: str = "normal") -> DataFrame:
    """One row: f1_macro over labels with support, fpr, per_class_recall (map), n_rows. No row for an empty table."""
    with_support = class_report(cells).filter("support > 0")
    recall = with_support.agg(F.mean("f1").alias("f1_macro"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "recall")))).alias("per_class_recall"))
    is_normal = F.col("truth") == normal
    whole = cells.agg(_ratio(F.sum(F.when(is_normal & (F.col("predicted") != normal), F.col("n")).otherwise(0)), F.sum(F.when(is_normal, F.col("n")).otherwise(0))).alias("fpr"), F.sum("n").alias("n_rows")).filter("n_rows > 0")
    return whole.join(F.broadcast(recall)).select("f1_macro", "fpr", "per_class_recall", "n_rows")


def steps(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """score, tp, fp at or above it, and the totals p, n: the distinct scores from the highest down."""
    cells = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    # null scores count as no rows and go once all is summed up: a filter before would find all scores a second time
    cells = cells.withColumns({n: F.when(F.col("score").isNotNull(), F.col(n)).otherwise(0) for n in ("pos", "neg")})
    cells = running_sums(cells.withColumn("_down", -F.col("score")), ["_down"], {"tp": F.col("pos"), "fp": F.col("neg")}).filter("score is not null")
    totals = cells.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # one row; the scores are not found again for it
    return cells.select("score", "pos", "neg", "tp", "fp").join(F.broadcast(totals))


def roc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, fpr, tpr at every distinct score."""
    return steps(df, score, positive).select(F.col("score").alias("threshold"), F.round(_ratio(F.col("fp"), F.col("n")), 6).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("p")), 6).alias("tpr"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: area under the ROC curve, ties counted half."""
    s = steps(df, score, positive)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return s.agg((area / F.nullif(F.max("p").cast("double") * F.max("n"), F.lit(0.0))).alias("a")).select(F.round("a", 6).alias("auc"))


def class_auc(df: DataFrame, labels: list[str], truth: str, prefix: str) -> DataFrame:
    """label, auc: one against the rest, by the probability column of each label."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [auc(df, f"{prefix}{x}", F.col(truth) == x).select(F.lit(x).alias("label"), "auc") for x in labels])


def thinned(curve: DataFrame, by: str, points: int = 50) -> DataFrame:
    """Every k-th row of a curve, so that at most so many remain."""
    n = curve.agg(F.greatest(F.ceil(F.count("*") / points), F.lit(1)).alias("_k"))  # one row
    return with_position(curve, [by], "_at").join(F.broadcast(n)).filter(F.col("_at") % F.col("_k") == 0).drop("_at", "_k")


def precision_recall(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, precision, recall at every distinct score."""
    s = steps(df, score, positive)
    return s.select(F.col("score").alias("threshold"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(_ratio(F.col("tp"), F.col("p")), 6).alias("recall"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: sum of precision times the gain in recall."""
    s = steps(df, score, positive)
    return s.agg(F.round(F.sum(_ratio(F.col("pos"), F.col("p")) * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))), 6).alias("average_precision"))


def detector_report(df: DataFrame, flag: Column, positive: Column) -> DataFrame:
    """One row: tp, fp, tn, fn, fpr, detection_rate of a flag."""
    c = df.agg(F.count_if(positive & flag).alias("tp"), F.count_if(~positive & flag).alias("fp"), F.count_if(~positive & ~flag).alias("tn"), F.count_if(positive & ~flag).alias("fn"))
    return c.select("*", F.round(_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("detection_rate"))


def matched_fpr(df: DataFrame, score: str, positive: Column, quantile: float = 0.95) -> DataFrame:
    """One row: the quantile of the benign scores as threshold, FPR and detection rate strictly above it."""
    t = quantiles(df.filter(~positive), [], score, [quantile]).select(F.col("q")[0].alias("threshold"))  # one row
    hit = F.col(score) > F.col("threshold")
    rows = df.join(F.broadcast(t))
    return rows.groupBy("threshold").agg(F.round(_ratio(F.count_if(~positive & hit), F.count_if(~positive)), 6).alias("fpr"), F.round(_ratio(F.count_if(positive & hit), F.count_if(positive)), 6).alias("detection_rate")).withColumn("threshold", F.round("threshold", 6))


#: Percentiles of all scores that a sweep tries, beside 0, the least and the largest score.
SWEPT = [5, 10, 20, 30, 40, 50, 60, 70, 80, 85, 90, 92, 94, 95, 96, 97, 98, 99]


def threshold_sweep(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, fp, tp, tn, fn, fpr, detection_rate, precision at the swept thresholds (flag: score above it).

    Scores are compared with the thresholds as they are; only what is returned is rounded.
    """
    q = quantiles(df, [], score, [p / 100 for p in SWEPT]).join(F.broadcast(df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))))  # two one-row tables
    thresholds = q.select(F.array_distinct(F.concat("q", F.array(F.lit(0.0), F.col("lo"), F.col("hi")))).alias("ts"))  # one row
    cells = df.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    hit = cells.join(F.broadcast(thresholds)).select("s", "pos", "neg", F.explode("ts").alias("threshold"))
    over = F.col("s") > F.col("threshold")
    sums = hit.groupBy("threshold").agg(*[F.sum(F.when(c, F.col(v)).otherwise(0)).alias(n) for n, c, v in (("fp", over, "neg"), ("tp", over, "pos"), ("tn", ~over, "neg"), ("fn", ~over, "pos"))])
    rates = [("fpr", "fp", "tn"), ("detection_rate", "tp", "fn"), ("precision", "tp", "fp")]
    return sums.select(F.round("threshold", 6).alias("threshold"), "fp", "tp", "tn", "fn", *[F.round(_ratio(F.col(a), F.col(a) + F.col(b)), 6).alias(n) for n, a, b in rates])


def rate_by(df: DataFrame, group: str, flag: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.mean(flag.cast("double")), 6).alias("rate"))


def ks_statistic(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: the largest distance between the distribution functions of the two groups."""
    s = steps(df, value, group)
    gap = F.abs(_ratio(F.col("tp"), F.col("p")) - _ratio(F.col("fp"), F.col("n")))
    return s.agg(F.round(F.coalesce(F.max(gap), F.lit(0.0)), 6).alias("ks"))


def youden(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: threshold and gain of the value that best parts attacks at or above it from benign ones; the lowest wins a tie."""
    s = steps(df, value, positive)
    gain = F.round(_ratio(F.col("tp"), F.col("p")) - _ratio(F.col("fp"), F.col("n")), 12)
    best = F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("t")))
    return s.agg(best.alias("b")).select((-F.col("b.t")).alias("threshold"), F.round("b.gain", 6).alias("gain"))


def zero_day(df: DataFrame, label: str, predicted: str, anomalous: Column, rows: str | None = None) -> DataFrame:
    """By class: n, share that the classifier misses, share that the detector flags, share that either catches, and predictions (class -> rows).

    A row that the detector has no verdict on isn't flagged; a null prediction counts as "none" and as no miss.
    With rows each row stands for as many as that column says, and anomalous is how many of them are flagged.
    """
    named = F.coalesce(predicted, F.lit("none"))
    miss = named == "normal"
    total = F.col(rows) if rows else F.lit(1)
    flagged = anomalous if rows else F.coalesce(anomalous, F.lit(False)).cast("long")
    checks = {"miss_rate": F.when(miss, total).otherwise(0), "detection_rate": flagged, "covered": F.when(miss, flagged).otherwise(total)}
    cells = df.filter(F.col(label) != "normal").groupBy(label, named.alias("_p")).agg(F.sum(total).cast("long").alias("_c"), *[F.sum(c).alias(f"_{n}") for n, c in checks.items()])
    rates = [F.round(F.sum(f"_{n}") / F.sum("_c"), 6).alias(n) for n in checks]
    # a row for each pair of classes is left
    return cells.groupBy(label).agg(F.sum("_c").alias("n"), *rates, F.map_from_entries(F.array_sort(F.collect_list(F.struct("_p", "_c")))).alias("predictions"))


def ablation(df: DataFrame, label: str, content: Column, behaviour: Column) -> DataFrame:
    """method, label, n, rate of the content check, the behaviour check, and both together."""
    checks = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), c.cast("double").alias("fired")) for n, c in (("content", content), ("behaviour", behaviour), ("combined", content | behaviour))]))
    return df.select(label, checks.alias("c")).groupBy("c.method", label).agg(F.count("*").alias("n"), F.round(F.mean("c.fired"), 6).alias("rate"))


def shadow_report(champion: DataFrame, candidate: DataFrame, key: str = "id") -> DataFrame:
    """One row: n, agreement, what one blocks and the other allows, block rates."""
    both = champion.select(key, F.col("predicted").alias("a")).join(candidate.select(key, F.col("predicted").alias("b")), key)
    block = lambda c: F.col(c) != "normal"
    r = lambda c: F.round(F.mean(c.cast("double")), 6)
    return both.agg(F.count("*").alias("n"), r(F.col("a") == F.col("b")).alias("agreement"), F.count_if(block("a") & ~block("b")).alias("candidate_allows"), F.count_if(~block("a") & block("b")).alias("candidate_blocks"), r(block("a")).alias("champion_block_rate"), r(block("b")).alias("candidate_block_rate"))


def latency(timings: DataFrame, seconds: str, rows: str) -> DataFrame:
    """One row: p50 and p95 of milliseconds a row over batches timed; no task holds the different values of all batches."""
    ms = F.col(seconds) * 1000 / F.col(rows)
    return quantiles(timings.select(ms.alias("_ms")), [], "_ms", [0.5, 0.95]).select(F.round(F.col("q")[0], 6).alias("p50_ms"), F.round(F.col("q")[1], 6).alias("p95_ms"))


def scoring_times(score, df: DataFrame, key: str, batches: int = 8) -> DataFrame:
    """batch, rows, seconds: how long score(rows) takes over all its columns, for batches by the hash of the key.

    Every row is scored once. A batch without rows isn't listed.
    """
    import time

    found, part = [], F.pmod(F.xxhash64(key), F.lit(batches))
    for i in range(batches):
        rows, began = score(df.filter(part == i)), time.time()
        n = rows.agg(F.count("*").alias("n"), F.max(F.xxhash64(*rows.columns))).first().n  # every column is needed
        found.append((i, n, time.time() - began))
    return df.sparkSession.createDataFrame([f for f in found if f[1]], "batch int, rows long, seconds double")


def permuted(df: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """df with one column shuffled: rows take the value of the row of the same rank by another hash."""
    from trafficwarden.operators.curate import sample_key
    # the first digits of the hash rise with it: 4,096 even buckets, without a sort of all rows
    at = lambda d, s, out: with_position(d.withColumn("_h", sample_key(key, s)), ["_h", key], out, bucket=F.substring("_h", 1, 3)).drop("_h")
    values = at(df.select(key, column), f"{seed}:values", "_at").select("_at", column)
    return at(df.drop(column), f"{seed}:rows", "_at").join(values, "_at").drop("_at")


def permutation_importance(df: DataFrame, features: list[str], key: str, score, positive: Column) -> DataFrame:
    """feature, drop: how much AUC is lost when a feature is shuffled; score(df) adds the column score."""
    from functools import reduce

    df = kept(df)  # each feature reads the rows twice
    base = auc(score(df), "score", positive).withColumnRenamed("auc", "_base")
    rows = [auc(score(permuted(df, f, key, i)), "score", positive).join(F.broadcast(base)).select(F.lit(f).alias("feature"), F.round(F.col("_base") - F.col("auc"), 6).alias("drop")) for i, f in enumerate(features)]
    return reduce(DataFrame.unionByName, rows)
