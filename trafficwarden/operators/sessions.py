"""Sessions: steps, gaps, idle-gap sessions, content and behaviour checks, and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficwarden.functions.text import LABELS
from trafficwarden.operators.metrics import youden
from trafficwarden.operators.order import in_groups, kept, quantiles


def with_steps(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """df with step_index from 0 and gap_seconds to the step before (0 for the first); a session of any length is spread over tasks."""
    seconds = lambda c: F.unix_micros(c) / 1e6
    rows = in_groups(df, session, [ts, tie], ts, F.lit(1), "step_index")
    gap = F.coalesce(F.round(seconds(F.col(ts)) - seconds(F.col("_before")), 6), F.lit(0.0))
    return rows.withColumns({"step_index": (F.col("step_index") - 1).cast("int"), "gap_seconds": gap}).drop("_before")


def idle_gap_sessions(df: DataFrame, client: str = "client", ts: str = "ts", tie: str = "id", idle: int = 1800, given: str | None = None) -> DataFrame:
    """df with session_id: a client's rows apart by at most so many seconds are one session.

    Where a column ``given`` has a session id, that stays; only rows without one (null or empty) are
    put together by their gaps (and numbered within the client: given ids must not look so). A null client is a client. Clients of any number of rows are spread over tasks.
    """
    apart = (F.unix_micros(ts) - F.unix_micros("_before")) > idle * 1_000_000
    new = F.coalesce(apart, F.lit(True)).cast("int")
    named = lambda rows: F.concat_ws("-", F.col(client).cast("string"), rows.cast("string"))
    if given is None:
        return in_groups(df, client, [ts, tie], ts, new, "_number").withColumn("session_id", named(F.col("_number"))).drop("_number", "_before")
    has = F.coalesce(F.col(given).cast("string") != "", F.lit(False))
    found = in_groups(df.filter(~has), client, [ts, tie], ts, new, "_number").withColumn("_session", named(F.col("_number"))).drop("_number", "_before")
    return df.filter(has).withColumn("_session", F.col(given).cast("string")).unionByName(found).drop("session_id").withColumnRenamed("_session", "session_id")


def collected(df: DataFrame, text: str = "query_canonical", score: str = "score", session: str = "session_id") -> DataFrame:
    """session_id, steps (array of step_index, text, score in order), session_text (texts joined by one space)."""
    steps = F.array_sort(F.collect_list(F.struct("step_index", F.col(text).alias("text"), F.col(score).alias("score"))))
    out = df.groupBy(session).agg(steps.alias("steps"))
    return out.withColumn("session_text", F.array_join(F.transform("steps", lambda s: s["text"]), " "))


def behaviour(df: DataFrame, per_query: float | Column, score: str = "score", session: str = "session_id") -> DataFrame:
    """session_id, steps, mean_score, fraction_above (strictly above the threshold)."""
    limit = per_query if isinstance(per_query, Column) else F.lit(per_query)
    return df.groupBy(session).agg(F.count("*").alias("steps"), F.round(F.mean(score), 6).alias("mean_score"), F.round(F.mean((F.col(score) > limit).cast("double")), 6).alias("fraction_above"))


def verdict(df: DataFrame, content: float, mean: float, fraction: float, probability: str = "attack_prob", top: str = "top_label") -> DataFrame:
    """df with fires_content, fires_behavior, is_attack, predicted_label. Names, not ids: sessions and queries number their labels differently."""
    c = F.col(probability) >= content
    b = (F.col("mean_score") >= mean) | (F.col("fraction_above") >= fraction)
    label = F.when(c, F.col(top)).when(b, "anomalous_session").otherwise("benign")
    return df.withColumns({"fires_content": c, "fires_behavior": b, "is_attack": c | b, "predicted_label": label})


def calibrate(steps: DataFrame, sessions: DataFrame, percentile: float = 0.9, score: str = "score") -> DataFrame:
    """One row: per_query, mean, fraction, content thresholds.

    steps has session_id, score; sessions has session_id, label (0 benign), attack_prob. per_query is
    the percentile of the benign steps' scores; the others part attacks from benign sessions best.
    """
    limit = steps.join(sessions.select("session_id", "label"), "session_id").filter("label = 0")
    limit = quantiles(limit, [], score, [percentile]).select(F.col("q")[0].alias("per_query"))  # one row
    per = steps.join(F.broadcast(limit)).groupBy("session_id").agg(F.round(F.mean(score), 6).alias("mean_score"), F.round(F.mean((F.col(score) > F.col("per_query")).cast("double")), 6).alias("fraction_above"))
    rows = kept(per.join(sessions, "session_id"))  # three thresholds are found in it
    attack = F.col("label") != 0
    found = [youden(rows, v, attack).select(F.col("threshold").alias(n)) for n, v in (("mean", "mean_score"), ("fraction", "fraction_above"), ("content", "attack_prob"))]
    out = limit.select(F.round("per_query", 6).alias("per_query"))
    for f in found:
        out = out.join(F.broadcast(f))  # one-row tables
    return out


def top_label(probabilities: list[str]) -> Column:
    """Name of the class of the largest probability; the first wins a tie."""
    pairs = F.array(*[F.struct(F.col(p).alias("p"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (p, n) in enumerate(zip(probabilities, LABELS))])
    return F.array_max(pairs)["n"]
