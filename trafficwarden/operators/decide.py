"""Verdicts: the three checks fused into one action, the worst step of a session, holds and their time-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fused(is_sqli: Column, is_anomaly: Column, session_attack: Column) -> Column:
    """Struct (action, reason). Null means that a check isn't there."""
    s = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(session_attack, F.lit(False)), s("BLOCK", "session flagged as attack"))
        .when(is_sqli.isNull(), s("UNKNOWN", "classifier not available"))
        .when(is_sqli, s("BLOCK", "attack class detected"))
        .when(F.coalesce(is_anomaly, F.lit(False)), s("OVERKILL", "normal but anomalous: held for review"))
        .when(is_anomaly.isNotNull(), s("ALLOW", "normal and no anomaly"))
        .otherwise(s("ALLOW", "normal; anomaly check not available"))
    )


def decide(df: DataFrame) -> DataFrame:
    """df with action and reason from is_sqli, is_anomaly, session_attack."""
    out = df.withColumn("_d", fused(F.col("is_sqli"), F.col("is_anomaly"), F.col("session_attack")))
    return out.withColumn("action", F.col("_d.action")).withColumn("reason", F.col("_d.reason")).drop("_d")


def worst_step(df: DataFrame, session: str = "session_id", keep: list[str] | None = None) -> DataFrame:
    """Of each session the first step that is an attack, else the first step."""
    best = F.min(F.struct((~F.col("is_sqli")).alias("_clean"), "step_index", *(keep or ["is_sqli"])))
    return df.groupBy(session).agg(best.alias("b")).select(session, "b.step_index", *[f"b.{c}" for c in keep or ["is_sqli"]])


def hold_outcome(decided: Column, created: Column, now: Column, timeout: int = 300) -> Column:
    """Outcome of a held query: what was decided, deny after the time-out, else still held."""
    return F.coalesce(decided, F.when(F.unix_micros(now) - F.unix_micros(created) > timeout * 1_000_000, "deny"), F.lit("held"))
