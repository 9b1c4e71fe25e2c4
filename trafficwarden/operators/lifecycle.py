"""Review queue, data versions, promotion gate and stage log, over append-only tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.functions.text import label_id
from trafficwarden.operators.curate import flagged, keep_first, with_truth

# Review queue.


def enqueue(stored: DataFrame, incoming: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Incoming items that aren't stored yet, each once: what to append."""
    return keep_first(incoming, [key], order or [key]).join(stored.select(key), key, "left_anti")


ACTIONS = ["approve", "correct", "reject"]


def decide_items(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided, errors). decisions: id, action, label, decided_at. Of several the last holds.

    approve takes the AI label; correct a given one (the same label is an approval); reject none.
    Errors: unknown id or action, correct without a label, approve without an AI label.
    """
    last = keep_first(decisions, ["id"], ["decided_at", "action"], descending=True)
    j = last.join(items.select("id", "ai_label", "query_canonical", "round_id").withColumn("_known", F.lit(True)), "id", "left")
    error = (
        F.when(F.col("_known").isNull(), "unknown id").when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unknown action")
        .when((F.col("action") == "correct") & F.col("label").isNull(), "label missing").when((F.col("action") == "approve") & F.col("ai_label").isNull(), "no pre-label")
    )
    j = j.withColumn("error", error)
    same = (F.col("action") == "correct") & (F.col("label") == F.col("ai_label"))
    status = F.when(F.col("action") == "reject", "rejected").when((F.col("action") == "approve") | same, "approved").otherwise("corrected")
    final = F.when(F.col("action") == "reject", F.lit(None)).when(F.col("action") == "approve", F.col("ai_label")).otherwise(F.col("label"))
    fine = j.filter("error is null").select("id", "query_canonical", "round_id", "ai_label", status.alias("status"), final.alias("final_label"), "decided_at")
    return fine, j.filter("error is not null").select("id", "action", "error")


def queue_state(items: DataFrame, decided: DataFrame) -> DataFrame:
    """items with status (pending where undecided) and final_label."""
    return items.join(decided.select("id", "status", "final_label", "decided_at"), "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def queue_counts(state: DataFrame) -> DataFrame:
    """One row: pending, approved, corrected, rejected, acceptance_rate (null without approvals or corrections)."""
    c = state.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "corrected", "rejected")])
    return c.withColumn("acceptance_rate", F.round(F.col("approved") / F.nullif((F.col("approved") + F.col("corrected")).cast("double"), F.lit(0.0)), 6))


def confirmed_rows(decided: DataFrame) -> DataFrame:
    """Ledger rows of approved and corrected items."""
    return decided.filter(F.col("status").isin("approved", "corrected")).select("id", "query_canonical", F.col("final_label").alias("label"), label_id(F.col("final_label")).alias("label_id"), "ai_label", (F.col("status") == "corrected").alias("was_corrected"), F.col("decided_at").alias("confirmed_at"), "round_id")


def without_round(table: DataFrame, round_id: str) -> DataFrame:
    return table.filter(~F.col("round_id").eqNullSafe(round_id))


def page(state: DataFrame, status: str | None, limit: int, offset: int, round_id: str | None = None) -> DataFrame:
    """A page of the queue, oldest first."""
    rows = state if status is None else state.filter(F.col("status") == status)
    rows = rows if round_id is None else rows.filter(F.col("round_id") == round_id)
    return rows.orderBy("created_at", "id").offset(offset).limit(limit)


def harvest(stream: DataFrame, truth: DataFrame, confidence: float = 0.6) -> DataFrame:
    """Ledger rows of the flagged part of a stream, decided by the truth: id, ai_label, label, was_corrected."""
    rows = with_truth(flagged(stream, confidence), truth)
    return rows.select("id", F.col("predicted").alias("ai_label"), F.col("truth").alias("label"), (F.col("predicted") != F.col("truth")).alias("was_corrected"), "review_source")


def reset(rounds: DataFrame, versions: DataFrame, round_id: str) -> tuple[DataFrame, DataFrame]:
    """Back to the baseline: rows without the round, and the protected versions."""
    return without_round(rounds, round_id), versions.filter("protected")


# Data versions.


def content_hash(df: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """One row: n, content_hash of (id, label) pairs in any order.

    The SHA-256 of each row is four whole numbers; their sums over all rows, with the number of rows,
    are hashed again. Sums are added up in the tasks, so no task holds more than four numbers.
    """
    row = F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(label).cast("string"), F.lit(""))), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws(":", "n", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("content_hash"))


def run_id(config: dict, data_hash: str, seed: int) -> str:
    """The same for the same configuration, data and seed: 12 hexadecimal digits."""
    return sha256(json.dumps({"config": config, "data": data_hash, "seed": seed}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


def run_ids(runs: DataFrame) -> DataFrame:
    """runs with run_id, as ``run_id`` gives it, from config (JSON, or a map of strings), data_hash and seed; null where one of them is."""

    @F.pandas_udf("string")
    def ids(config: pd.Series, data_hash: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or h is None or pd.isna(s) else run_id(json.loads(c), h, int(s)) for c, h, s in zip(config, data_hash, seed)], dtype=object)

    config = F.col("config") if runs.schema["config"].dataType.typeName() == "string" else F.to_json("config")
    return runs.withColumn("run_id", ids(config, F.col("data_hash"), F.col("seed")))


def _parts(version: Column) -> tuple[Column, Column]:
    return F.split(version, "\\.")[0].cast("int"), F.split(version, "\\.")[1].cast("int")


def latest_version(versions: DataFrame) -> DataFrame:
    """The row of the highest (major, minor)."""
    major, minor = _parts(F.col("version"))
    best = F.max_by(F.struct("*"), F.struct(major, minor))
    return versions.agg(best.alias("v")).select("v.*")


def next_version(parent: Column, parent_labels: Column, labels: Column) -> Column:
    """Struct (bump, version, new_classes): new classes raise the major number, other changes the minor one; 1.0 without parent."""
    fresh = F.array_sort(F.array_except(labels, F.coalesce(parent_labels, F.array().cast("array<string>"))))
    major, minor = _parts(parent)
    bump = F.when(parent.isNull(), "initial").when(F.size(fresh) > 0, "major").otherwise("minor")
    version = F.when(parent.isNull(), "1.0").when(F.size(fresh) > 0, F.concat((major + 1).cast("string"), F.lit(".0"))).otherwise(F.concat_ws(".", major.cast("string"), (minor + 1).cast("string")))
    return F.struct(bump.alias("bump"), version.alias("version"), fresh.alias("new_classes"))


def seal(versions: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (parent, label_space, content_hash) with bump, version, and error: same content sealed before, or unknown parent."""
    p = versions.select(F.col("version").alias("parent"), F.col("label_space").alias("_labels"))
    known = versions.select("content_hash", F.lit(True).alias("_seen")).distinct()
    j = candidates.join(p, "parent", "left").join(known, "content_hash", "left")
    n = next_version(F.col("parent"), F.col("_labels"), F.col("label_space"))
    error = F.when(F.col("_seen"), "content already sealed").when(F.col("parent").isNotNull() & F.col("_labels").isNull(), "unknown parent")
    return j.select("parent", "content_hash", "label_space", n["bump"].alias("bump"), F.when(error.isNull(), n["version"]).alias("version"), n["new_classes"].alias("new_classes"), error.alias("error"))


def removable(versions: DataFrame, names: DataFrame) -> DataFrame:
    """names with what stands against their removal: unknown, or protected."""
    j = names.join(versions.select("version", "protected"), "version", "left")
    return j.select("version", F.when(F.col("protected").isNull(), "unknown version").when(F.col("protected"), "protected").alias("error"))


def next_training_set(train: DataFrame, confirmed: DataFrame, text: str = "query_canonical", at: str = "confirmed_at") -> DataFrame:
    """The training part and the confirmed rows; of equal texts the last confirmed label holds."""
    base = train.select("id", text, "label", F.lit(None).cast("timestamp").alias(at), F.lit(0).alias("_rank"))
    new = confirmed.select("id", text, "label", at, F.lit(1).alias("_rank"))
    return keep_first(base.unionByName(new), [text], ["_rank", at, "id"], descending=True).drop("_rank", at)


def with_new_class(golden: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """The golden set and the held-out rows of a new class, each once: a superset of the golden set."""
    return golden.unionByName(held.join(golden.select(key), key, "left_anti"))


# Gate.


def gate(pairs: DataFrame, drop: float = 0.02, new_recall: float = 0.8, min_f1: float | None = None, max_fpr: float | None = None) -> DataFrame:
    """pairs with verdict, comparison, regressions, weak_new. pairs: structs candidate and champion (null: none) of
    data_version, f1_macro, fpr, per_class_recall."""
    c, h = "candidate", "champion"
    major = lambda s: F.split(F.col(f"{s}.data_version"), "\\.")[0]
    cand, champ = F.col(f"{c}.per_class_recall"), F.col(f"{h}.per_class_recall")
    lost = F.map_filter(F.transform_values(champ, lambda k, v: F.round(v - F.coalesce(F.try_element_at(cand, k), F.lit(0.0)), 6)), lambda k, v: v > drop)
    weak = F.map_filter(cand, lambda k, v: ~F.coalesce(F.map_contains_key(champ, k), F.lit(False)) & (v < new_recall))
    f1 = F.col(f"{c}.f1_macro") >= (F.col(f"{h}.f1_macro") if min_f1 is None else F.lit(min_f1))
    fpr = F.col(f"{c}.fpr") <= (F.col(f"{h}.fpr") if max_fpr is None else F.lit(max_fpr))
    fine = f1 & fpr & (F.size(F.map_keys(lost)) == 0) & (F.size(F.map_keys(weak)) == 0)
    none, other = F.col(h).isNull(), major(c) != major(h)
    return pairs.select(
        "*", F.when(none | other, "direct_promote").when(fine, "promote").otherwise("reject").alias("verdict"),
        F.when(none, "no_champion").when(other, "cross_major_refused").otherwise("same_major").alias("comparison"),
        F.when(~none & ~other, F.array_sort(F.map_keys(lost))).alias("regressions"), F.when(~none & ~other, F.array_sort(F.map_keys(weak))).alias("weak_new"),
        F.when(~none & ~other, f1).alias("f1_ok"), F.when(~none & ~other, fpr).alias("fpr_ok"),
    )


def quality_floor(evaluations: DataFrame, min_f1: float, max_fpr: float, min_recall: float) -> DataFrame:
    """evaluations with passed and failing: the floors that a major version must reach by itself."""
    weak = F.array_sort(F.map_keys(F.map_filter("per_class_recall", lambda k, v: v < min_recall)))
    checks = F.array_compact(F.array(F.when(F.col("f1_macro") < min_f1, "f1_macro"), F.when(F.col("fpr") > max_fpr, "fpr"), F.when(F.size(weak) > 0, "recall")))
    return evaluations.select("*", (F.size(checks) == 0).alias("passed"), checks.alias("failing"), weak.alias("weak_classes"))


def shadow_gate(evaluation: DataFrame, champion_fpr: float, golden_f1: float, fpr_slack: float = 0.005, f1_slack: float = 0.02) -> DataFrame:
    """The evaluation on shadow traffic with passed."""
    ok = (F.col("fpr") <= champion_fpr + fpr_slack) & (F.col("f1_macro") >= golden_f1 - f1_slack)
    return evaluation.select("f1_macro", "fpr", "n_rows", ok.alias("passed"))


# Stage log.


LOG = ["branch", "at", "action", "version"]
_LOG_TYPES = "branch string, at long, action string, version string"


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those of each branch from its last two unequal promotions in a row, which settle the state whatever came before."""
    held, last, previous = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = 0
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("branch", "action", "version")))):
            if last is None or row[0] != last[0]:
                yield from [*held, batch.slice(begin, i - begin)]
                held, begin = [], i
            elif row[1] == last[1] == "promote" and row[2] != last[2]:
                held, begin = ([], i - 1) if i else ([previous.slice(previous.num_rows - 1)], 0)
            last = row
        held, previous = [*held, batch.slice(begin)], batch
        if len(held) > 64:  # more rows than needed do no harm
            yield from held
            held = []
    yield from held


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """branch, version in production, of sorted rows. Only the two latest versions of a branch can go live without a promotion."""
    branch, first, second, live, any_row = None, None, None, False, False
    for batch in batches:
        out = []
        for name, action, version in zip(*(batch.column(c).to_pylist() for c in ("branch", "action", "version"))):
            if not any_row or name != branch:
                out += [(branch, first)] if live else []
                branch, first, second, live, any_row = name, None, None, False, True
            if action == "promote":
                first, second, live = version, second if version == first else first, True
            elif action == "clear":
                live = False
            elif live and second is not None:
                first, second = second, first
            else:
                live = first is not None
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["branch", "live"])
    if live:
        yield pa.RecordBatch.from_arrays([pa.array([branch], pa.string()), pa.array([first], pa.string())], ["branch", "live"])


def stages(events: DataFrame) -> DataFrame:
    """branch, version, stage now. events: at (long), branch, action (promote, rollback, clear), version.

    A promotion archives what was in production, a roll-back puts the latest archived version back, a
    clearing archives. No version leaves the log, so all promoted ones are listed; what is live is
    folded in order. The log is dealt out by branch and time, and each part passes on only the rows
    that can still matter; these are read one after the other, with three values kept for a branch.
    Promotions of no version are no events.
    """
    known = events.filter(F.col("action").isin("rollback", "clear") | ((F.col("action") == "promote") & F.col("version").isNotNull()))
    log = known.select(F.col("branch").cast("string").alias("branch"), F.col("at").cast("long").alias("at"), "action", F.col("version").cast("string").alias("version"))
    tails = log.repartitionByRange(*LOG).sortWithinPartitions(*LOG).mapInArrow(_tails, _LOG_TYPES)
    live = tails.repartition("branch").sortWithinPartitions(*LOG).mapInArrow(_fold, "branch string, live string")
    versions = log.filter("action = 'promote'").select("branch", "version").distinct()
    found = versions.join(live.withColumnRenamed("branch", "_branch"), F.col("branch").eqNullSafe(F.col("_branch")), "left")
    return found.select("branch", "version", F.when(F.col("version") == F.col("live"), "production").otherwise("archived").alias("stage"))


def resolve_active(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """branch, version: the one in production, else the baseline."""
    live = stages(events).filter("stage = 'production'").select("branch", F.col("version").alias("_live"))
    return baselines.join(live, "branch", "left").select("branch", F.coalesce("_live", "version").alias("version"))


def newest_first(df: DataFrame, at: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(at), *[c for c in df.columns if c != at]).limit(limit)


def merged_log(logs: dict[str, DataFrame], at: str, keys: list[str]) -> DataFrame:
    """Several logs as one, with log (its name) and a dense position in order of time, log and keys; columns that a log lacks are null."""
    from functools import reduce

    from trafficwarden.operators.order import with_position

    named = [df.withColumn("log", F.lit(name)) for name, df in logs.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return with_position(rows, [at, "log", *keys], bucket=F.date_trunc("hour", at))


def first_reaching(df: DataFrame, position: str, flag: Column, count: int, bucket: Column | None = None) -> DataFrame:
    """One row: the first position at which so many flagged rows have come (null if never)."""
    from trafficwarden.operators.order import running_sum

    rows = running_sum(df.select(position, flag.cast("long").alias("_f")), [position], F.col("_f"), "_sum", bucket if bucket is not None else F.floor(F.col(position) / 1_000_000))
    return rows.filter((F.col("_f") == 1) & (F.col("_sum") == count)).agg(F.min(position).alias("position"))
