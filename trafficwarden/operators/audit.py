"""Corpus audits: profiles, leakage, invariants, histograms and densities, each one small table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.functions.text import CALLBACKS, is_callback, is_template
from trafficwarden.operators.order import quantiles


def profile(df: DataFrame, columns: list[str], distinct: list[str]) -> DataFrame:
    """metric, value, n: rows, the count of each value of the columns, and distinct values. One pass over df for the counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.metric", "p.value").agg(F.count("*").alias("n")).select("metric", "value", "n")
    whole = df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct])
    names = ["rows", *[f"distinct_{c}" for c in distinct]]
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(None).cast("string").alias("value"), F.col(n).cast("long").alias("n")) for n in names]))
    return counts.unionByName(whole.select(stack.alias("p")).select("p.*"))


def approximate_distinct(df: DataFrame, columns: list[str], error: float = 0.02) -> DataFrame:
    return df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in columns])


def duplicate_leakage(df: DataFrame, text: str = "query_canonical", split: str = "split") -> DataFrame:
    """One row: extra_copies, duplicated_texts, straddling (texts in two splits)."""
    per = df.groupBy(text).agg(F.count("*").alias("n"), (F.min(split) != F.max(split)).alias("both"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"), F.count_if(F.col("n") > 1).alias("duplicated_texts"), F.count_if("both").alias("straddling"))


def callback_labels(df: DataFrame, text: str = "query_canonical", label: str = "label_name") -> DataFrame:
    """Rows with call-back marks by label, and of each mark."""
    marks = [F.count_if(F.contains(F.lower(text), F.lit(c))).alias(f"n_{i}") for i, c in enumerate(CALLBACKS)]
    return df.filter(is_callback(F.col(text))).groupBy(label).agg(F.count("*").alias("n"), *marks)


def template_rows(df: DataFrame, text: str = "query_canonical", label: str = "label_name") -> DataFrame:
    """By label: rows of the template path, their share of the label's rows, distinct texts."""
    hit = is_template(F.col(text))
    return df.groupBy(label).agg(F.count_if(hit).alias("n"), F.round(F.count_if(hit) / F.count("*"), 6).alias("share"), F.count_distinct(F.when(hit, F.col(text))).alias("distinct"))


def label_by_split(df: DataFrame, label: str, split: str, values: list[str]) -> DataFrame:
    return df.groupBy(label).pivot(split, values).count().fillna(0)


def partition_counts(df: DataFrame, label: str, part: str) -> DataFrame:
    """Rows of each label and partition, with totals where one or both are null."""
    return df.rollup(label, part).agg(F.count("*").alias("n"))


def _with_quantiles(out: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """out with the array q of each group, null groups included; null where a group has no value."""
    if not by:
        return out.join(F.broadcast(q))  # two one-row tables
    return out.alias("o").join(q.alias("q"), [F.col(f"o.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by], "left").select("o.*", "q.q")


def describe(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """group, feature, n, mean, std, min, p25, p50, p75, max."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")).select(group, "p.*")
    r = lambda c: F.round(c, 6)
    out = long.groupBy(group, "feature").agg(F.count("x").alias("n"), r(F.mean("x")).alias("mean"), r(F.stddev_samp("x")).alias("std"), r(F.min("x")).alias("min"), r(F.max("x")).alias("max"))
    out = _with_quantiles(out, quantiles(long, [group, "feature"], "x", [0.25, 0.5, 0.75]), [group, "feature"])
    return out.select(group, "feature", "n", "mean", "std", "min", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def score_stats(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, p50, p90, p99, max of a score."""
    out = df.groupBy(*(by or [])).agg(F.count(score).alias("n"), F.round(F.mean(score), 6).alias("mean"), F.round(F.max(score), 6).alias("max"))
    out = _with_quantiles(out, quantiles(df, by or [], score, [0.5, 0.9, 0.99]), by or [])
    return out.select(*(by or []), "n", "mean", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))], "max")


def stream_manifest(stream: DataFrame, size: int, text: str = "query_raw") -> DataFrame:
    """One row: rows, windows, attack_rate, unique_texts, and the mix of classes as a map."""
    mix = stream.groupBy("label_name").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_name", "n")))).alias("mix"))
    whole = stream.agg(F.count("*").alias("rows"), F.ceil(F.count("*") / size).alias("windows"), F.round(F.mean((F.col("label_name") != "normal").cast("double")), 6).alias("attack_rate"), F.count_distinct(text).alias("unique_texts"))
    return whole.join(F.broadcast(mix))  # two one-row tables


def invariants(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """name, passed, detail: each check is a one-row table and what must hold of it."""
    rows = [df.select(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), F.to_json(F.struct("*")).alias("detail")) for n, (df, ok) in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def write_if_sound(df: DataFrame, path: str, checks: DataFrame, by: str) -> None:
    """Write df if all checks passed; otherwise say which failed."""
    failed = [r.name for r in checks.filter("not passed").collect()]
    if failed:
        raise ValueError(f"invariants failed: {', '.join(failed)}")
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """bin (from 1; the top edge is in the last), n."""
    b = F.when(F.col(value) == high, bins).otherwise(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)))
    return df.withColumn("bin", b.cast("int")).filter(F.col("bin").between(1, bins)).groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, low: float, high: float, points: int = 300) -> DataFrame:
    """x, density: Gaussian kernels of Scott's bandwidth over the clipped values, at so many points.

    Equal values are counted first, and every value adds to all points within its own row.
    """
    clipped = df.select(F.greatest(F.lit(low), F.least(F.lit(high), F.col(value).cast("double"))).alias("v")).filter("v is not null")
    counts = clipped.groupBy("v").agg(F.count("*").alias("n"))
    width = clipped.agg(F.count("*").alias("total"), F.stddev_samp("v").alias("s")).select("total", (F.col("s") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("h"))
    x = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    rows = counts.join(F.broadcast(width)).select("v", "n", "total", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    kernel = F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), 2)) / (F.col("h") * (2 * 3.141592653589793) ** 0.5)
    return rows.groupBy("i").agg(F.sum(F.col("n") * kernel / F.col("total")).alias("d")).select(F.round(x, 6).alias("x"), F.round("d", 6).alias("density"))


def session_meta(sessions: DataFrame) -> DataFrame:
    """A row for each session: steps, label, source, split of its first step."""
    first = F.min(F.struct("step_index", "session_label", "session_source", "split"))
    return sessions.groupBy("session_id").agg(F.count("*").alias("steps"), first.alias("f")).select("session_id", "steps", "f.session_label", "f.session_source", "f.split")


def session_leakage(sessions: DataFrame, text: str = "query_canonical") -> DataFrame:
    """One row: test sessions whose ordered texts equal a train session's, or that share a probe target and label with one."""
    from trafficwarden.functions.text import probe_target

    steps = F.array_sort(F.collect_list(F.struct("step_index", F.sha2(text, 256).alias("t"))))
    per = sessions.groupBy("session_id", "split", "session_label").agg(F.sha2(F.array_join(F.transform(steps, lambda s: s["t"]), ","), 256).alias("sequence"))
    train, test = per.filter("split = 'train'"), per.filter("split = 'test'")
    same = test.join(train.select("sequence"), "sequence", "left_semi").select("session_id")
    target = sessions.select("session_id", "split", "session_label", probe_target(F.col(text)).alias("target")).filter("target is not null").distinct()
    shared = target.filter("split = 'test'").join(target.filter("split = 'train'").select("target", "session_label").distinct(), ["target", "session_label"], "left_semi").select("session_id").distinct()
    counts = test.agg(F.count("*").alias("test_sessions")), same.agg(F.count("*").alias("same_sequence")), shared.agg(F.count("*").alias("shared_target"))
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one-row tables
