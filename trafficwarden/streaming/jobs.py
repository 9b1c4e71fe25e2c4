"""Structured Streaming jobs over arriving traffic. Every job takes a streaming (or batch) DataFrame with
id, ts (timestamp), client, query_raw and gives one back; sinks are the caller's, but for the two
helpers that need foreachBatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.functions import features as X
from trafficwarden.functions import text as T
from trafficwarden.operators import drift as R
from trafficwarden.operators.decide import decide
from trafficwarden.operators.order import spread
from trafficwarden.streaming.state import hold_timeouts, sustained_breaches  # noqa: F401

EVENTS = "id long, ts timestamp, client long, query_raw string, is_attack boolean, predicted string, confidence double, score double, label_name string"


def events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """New parquet files of a folder, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> None:
    """Write what there is and stop."""
    stream.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def verdicts(stream: DataFrame, classify=None, anomaly=None) -> DataFrame:
    """Arriving queries with canonical form, features and action: a projection without state.

    classify(df) adds is_sqli, anomaly(df) adds is_anomaly; without them the attack signatures and a
    high share of special signs stand in.
    """
    rows = X.with_features(T.canonicalize(stream), names=["length", "special_char_ratio", "entropy"])
    rows = classify(rows) if classify else rows.withColumn("is_sqli", T.any_signature(F.col("query_canonical")))
    rows = anomaly(rows) if anomaly else rows.withColumn("is_anomaly", F.col("special_char_ratio") > 0.3)
    return decide(rows.withColumn("session_attack", F.lit(None).cast("boolean")))


def window_rates(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, n, block_rate, low_confidence, mean_confidence of event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.round(F.mean((F.col("predicted") != "normal").cast("double")), 6).alias("block_rate"), F.round(F.mean((F.col("confidence") < 0.6).cast("double")), 6).alias("low_confidence"), F.round(F.mean("confidence"), 6).alias("mean_confidence"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "block_rate", "low_confidence", "mean_confidence")


def window_psi(stream: DataFrame, edges: list[float], ref: list[float], x: str = "score", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, n, psi of event-time windows against fixed reference bins (inner edges and shares)."""
    bin_ = R.bin_of(F.col(x), F.array(*[F.lit(float(e)) for e in edges]))
    rows = stream.withWatermark("ts", late).withColumn("bin", bin_)
    out = rows.groupBy(F.window("ts", size)).agg(F.count("*").alias("n"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(len(ref))])
    cur = F.array(*[F.col(f"b{i}") / F.col("n") for i in range(len(ref))])
    return out.select(F.col("window.start").alias("start"), "n", F.round(R.psi_of(cur, F.array(*[F.lit(float(r)) for r in ref])), 6).alias("psi"))


def replaced(df: DataFrame, table: str, number: int) -> None:
    """The rows of a micro-batch under its own number: a batch that is run again takes the place of what it wrote before."""
    df.write.mode("overwrite").parquet(f"{table}/batch={number}")


class CountWindows:
    """Micro-batches as bin counts of windows of so many rows, in order of ts and id; rows of a batch follow those of the one before.

    Each batch leaves window, bin, n and until (rows up to its end) in a folder of its own, so counts
    and offset are one commit, and a repeated batch or a restart changes nothing. A window that is cut
    by the end of a batch goes on in the next one; ``count_window_psi`` adds its parts up.
    """

    def __init__(self, edges: list[float], size: int, table: str, x: str = "score"):
        self.edges, self.size, self.table, self.x = edges, size, table, x

    def _before(self, spark: SparkSession, number: int) -> int:
        from trafficwarden.sources.readers import _exists

        last = f"{self.table}/batch={number - 1}"
        if _exists(spark, f"{last}/_SUCCESS"):
            return spark.read.parquet(last).agg(F.max("until")).first()[0]
        if number == 0 or not _exists(spark, self.table):
            return 0
        return spark.read.parquet(self.table).filter(F.col("batch") < number).agg(F.max("until")).first()[0] or 0

    def __call__(self, df: DataFrame, number: int) -> None:
        from trafficwarden.operators.order import with_position

        spark = df.sparkSession
        before = self._before(spark, number)
        rows = with_position(df.select("ts", "id", self.x), ["ts", "id"], bucket=F.date_trunc("hour", "ts"))
        bin_ = R.bin_of(F.col(self.x), F.array(*[F.lit(float(e)) for e in self.edges]))
        counts = rows.groupBy(F.floor((F.col("position") + before) / self.size).alias("window"), bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
        end = before + rows.count()
        mark = spark.range(1).select(F.lit(None).cast("long").alias("window"), F.lit(None).cast("int").alias("bin"), F.lit(0).cast("long").alias("n"))
        replaced(counts.select(F.col("window").cast("long").alias("window"), "bin", "n").unionByName(mark).withColumn("until", F.lit(end).cast("long")), self.table, number)


def count_window_counts(stream: DataFrame, edges: list[float], size: int, table: str, checkpoint: str, x: str = "score") -> None:
    """Run a stream to its end through ``CountWindows``."""
    stream.writeStream.foreachBatch(CountWindows(edges, size, table, x)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def count_window_psi(spark: SparkSession, table: str, size: int, ref: list[float]) -> DataFrame:
    """window, psi against fixed reference shares, of the windows that are full."""
    counts = spark.read.parquet(table).filter("window is not null").groupBy("window").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).alias(f"b{i}") for i in range(len(ref))])
    cur = F.array(*[F.col(f"b{i}") / F.col("n") for i in range(len(ref))])
    return counts.filter(F.col("n") == size).select("window", F.round(R.psi_of(cur, F.array(*[F.lit(float(r)) for r in ref])), 6).alias("psi"))


class ModelVerdicts:
    """Micro-batches scored by the model that is in production when they start.

    active() names the version, load(version) gives its fitted stages (canonical form, features,
    classifier, detector); it is asked once a version. A version that is promoted while a batch runs
    serves from the next one on. Each batch replaces its own folder; rows carry the version that
    judged them, so a repeated batch may be judged by a newer one, but is never there twice.
    """

    KEEP = ("predicted", "attack_prob", "is_sqli", "anomaly_score", "is_anomaly", "action", "reason")

    def __init__(self, active, load, table: str):
        self.active, self.load, self.table, self.known = active, load, table, {}

    def judged(self, df: DataFrame, version: str) -> DataFrame:
        """df with what the version's stages say and the action."""
        if version not in self.known:
            self.known = {version: self.load(version)}  # the one before is not needed any more
        rows = self.known[version].transform(spread(df.drop(*self.KEEP)))
        out = decide(rows.withColumns({"is_anomaly": F.col("is_anomaly") == 1, "session_attack": F.lit(None).cast("boolean")}))
        return out.select("id", "ts", "query_canonical", *self.KEEP, F.lit(version).alias("version"))

    def __call__(self, df: DataFrame, number: int) -> None:
        replaced(self.judged(df, self.active()), self.table, number)

    def run_to_end(self, stream: DataFrame, checkpoint: str) -> None:
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_rollup(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions by idle gap, given out when they are closed: client, start, steps, session_text, mean_score."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "id", "query_raw")))
    out = stream.withWatermark("ts", late).groupBy("client", F.session_window("ts", gap)).agg(F.count("*").alias("steps"), steps.alias("s"), F.round(F.mean("score"), 6).alias("mean_score"))
    return out.select("client", F.col("session_window.start").alias("start"), "steps", F.array_join(F.transform("s", lambda v: v["query_raw"]), " ").alias("session_text"), "mean_score")


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each id once, as long as the copy comes within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def with_late_count(stream: DataFrame, clock: Column, name: str = "late") -> DataFrame:
    """stream with a metric of the rows that are older than the clock; read it from the query's progress."""
    return stream.observe(name, F.count_if(F.col("ts") < clock).alias("late"), F.count("*").alias("rows"))


def late_counts(stream: DataFrame, clock: Column, checkpoint: str) -> DataFrame:
    """One row: late and all rows of a stream, as its own progress reports count them."""
    query = with_late_count(stream, clock).writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["late"] for p in query.recentProgress if "late" in p["observedMetrics"]]  # a row for each batch
    rows = [(int(m["late"]), int(m["rows"])) for m in seen]
    return stream.sparkSession.createDataFrame([tuple(map(sum, zip(*rows)))] if rows else [], "late long, rows long")


def retrain_triggers(confirmed: DataFrame, needed: int = 500) -> DataFrame:
    """round_id, n when a round reaches so many confirmed samples: at most once for a round."""
    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(p) for p in parts)
        state.update((int(now),))
        hit = before < needed <= now
        yield pd.DataFrame({"round_id": [key[0]] if hit else [], "n": [now] if hit else []})

    return confirmed.groupBy("round_id").applyInPandasWithState(step, "round_id string, n long", "n long", "append", "NoTimeout")
