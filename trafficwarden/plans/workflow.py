"""Continual learning over tables: train and seal, evaluate on golden rows, ablation arms, and the two-act scenario.

The driver sequences distributed steps and reads one-row results; tables and models lie under a root
folder that all executors share.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.functions.text import label_name
from trafficwarden.operators import curate as C
from trafficwarden.operators import drift as R
from trafficwarden.operators import lifecycle as L
from trafficwarden.operators import metrics as M
from trafficwarden.operators import models as ML
from trafficwarden.operators.order import kept, spread
from trafficwarden.sources.readers import append_ledger, read_ledger
from trafficwarden.sources.versions import VersionLedger

#: What is recorded of a finished run: its manifest.
RUNS = (
    "run_id string, status string, version string, bump string, content_hash string, config string, seed long, model string, rows long, train_rows long, valid_rows long, "
    "train_ids_hash string, valid_ids_hash string, valid_f1_macro double, valid_fpr double, f1_macro double, fpr double, per_class_recall map<string,double>"
)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df as a table under the root: later steps start from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evaluate_on_golden(model, golden: DataFrame, fresh: DataFrame | None = None, text: str = "query_canonical") -> DataFrame:
    """One row: the gate evaluation of a model on golden rows (and held-out rows of a new class). Rows of one text and class are scored once."""
    return _evaluated(model, _different(golden if fresh is None else L.with_new_class(golden, fresh), text), text)


def _different(rows: DataFrame, text: str = "query_canonical") -> DataFrame:
    """The text, label_name and _rows of the different pairs of text and class."""
    return spread(rows.groupBy(F.col(text).cast("string").alias(text), label_name(F.col("label")).alias("label_name")).agg(F.count("*").alias("_rows")))


def _evaluated(model, different: DataFrame, text: str = "query_canonical") -> DataFrame:
    return M.gate_evaluation(M.confusion(ML.classify(model, different, text), rows="_rows"))


def _ids_hash(df: DataFrame) -> str:
    return L.content_hash(df.withColumn("_", F.lit("")), "id", "_").first().content_hash


def train_and_seal(spark: SparkSession, root: str, train: DataFrame, confirmed: DataFrame | None, golden: DataFrame, config: dict, seed: int = 0, valid: float = 0.15, parent: str | None = None) -> dict:
    """Assemble, hash, seal, split, train, evaluate and record a run; an identical finished run is reported, not repeated.

    train and golden have id, query_canonical, label; confirmed also confirmed_at. The version follows
    from the labels of the data; where the same content is sealed already, its version is used, so a
    run that was lost after sealing goes on under it. A share of the rows is held out for validation;
    golden rows are never trained on. The manifest is added to the ledger of runs once all is done.
    """
    pool = train if confirmed is None else L.next_training_set(train, confirmed)
    digest = L.content_hash(pool).first()
    run = L.run_id(config, digest.content_hash, seed)
    found = read_ledger(spark, f"{root}/runs", RUNS).filter(F.col("run_id") == run).limit(1).collect()
    if found:
        return found[0].asDict() | {"repeated": True}
    versions = VersionLedger(spark, f"{root}/versions")
    labels = sorted(r[0] for r in pool.select(label_name(F.col("label"))).distinct().collect())  # a row a class
    try:
        sealed = versions.seal(labels, digest.n, digest.content_hash, parent, f"train run {run}", {"train": digest.n})
    except ValueError:
        sealed = versions.with_content(digest.content_hash)
        if sealed is None:
            raise
    rows = _kept(C.random_split(pool, "id", valid, seed, ("valid", "train")), f"{root}/splits/{run}")
    training, held = (rows.filter(F.col("split") == n).drop("split") for n in ("train", "valid"))
    options = {k: config[k] for k in ("vocabulary", "iterations") if k in config}
    model = ML.fit_classifier(training, **options)
    path = f"{root}/models/{sealed['version']}-{run}"
    ML.save_model(model, path)
    v, e = evaluate_on_golden(model, held).first(), evaluate_on_golden(model, golden).first()
    row = {
        "run_id": run, "status": "completed", "version": sealed["version"], "bump": sealed["bump"], "content_hash": digest.content_hash, "config": json.dumps(config, sort_keys=True), "seed": seed, "model": path,
        "rows": digest.n, "train_rows": training.count(), "valid_rows": held.count(), "train_ids_hash": _ids_hash(training), "valid_ids_hash": _ids_hash(held),
        "valid_f1_macro": v.f1_macro, "valid_fpr": v.fpr, "f1_macro": e.f1_macro, "fpr": e.fpr, "per_class_recall": e.per_class_recall,
    }
    append_ledger(spark.createDataFrame([row], RUNS), f"{root}/runs")
    return row | {"repeated": False}


def judged(spark: SparkSession, candidate: tuple, champion: tuple | None, **limits) -> DataFrame:
    """The gate's one row for (data_version, f1_macro, fpr, per_class_recall) of a candidate and a champion."""
    kind = "struct<data_version:string,f1_macro:double,fpr:double,per_class_recall:map<string,double>>"
    return L.gate(spark.createDataFrame([(candidate, champion)], f"candidate {kind}, champion {kind}"), **limits)


def promote(spark: SparkSession, root: str, candidate: dict, champion: dict | None) -> str:
    """Gate the candidate against the champion and record the decision: the verdict."""
    pack = lambda r: None if r is None else (r["version"], r["f1_macro"], r["fpr"], r["per_class_recall"])
    decision = judged(spark, pack(candidate), pack(champion)).withColumn("candidate_run", F.lit(candidate["run_id"]))
    append_ledger(decision, f"{root}/decisions")
    return decision.first().verdict


def ablation_arms(base: DataFrame, fresh: DataFrame, golden: DataFrame, config: dict) -> DataFrame:
    """arm, rows, f1_macro, fpr, new_recall, verdict of each pool against a champion trained on base alone.

    All new rows; balanced new rows; as many old rows instead (a control that must not know the new
    classes); 1 % rehearsal (starved). The gate judges each as a minor version; a control that
    recalls a new class would show that its recall comes from the number of rows.
    """
    n, options = fresh.count(), {k: config[k] for k in ("vocabulary", "iterations") if k in config}
    new = {r[0] for r in fresh.select(label_name(F.col("label"))).distinct().collect()} - {r[0] for r in base.select(label_name(F.col("label"))).distinct().collect()}  # classes
    # pools are unions of few tables, each counted by text and class once
    old, added = ML.counted_rows(base), ML.counted_rows(fresh)
    arms = {
        "champion": [old],
        "naive": [old, added],
        "balanced": [old, ML.counted_rows(C.balance(fresh, "label", "id"))],
        "volume_control": [old, ML.counted_rows(C.reservoir(base, "id", n, 7))],
        "starved": [added, ML.counted_rows(C.take(base, [], "id", F.bround(F.lit(0.01) * F.col("_n"))))],
    }
    asked = kept(_different(golden))

    def run(parts: list[DataFrame]) -> tuple:
        pool = parts[0]
        if len(parts) > 1:
            pool = kept(parts[0].unionByName(parts[1]).groupBy("query_canonical", "_y").agg(F.sum("_rows").alias("_rows")))
        return pool.agg(F.sum("_rows")).first()[0] or 0, _evaluated(ML.fit_counted(pool, **options), asked).first()

    rows, champion = [], None
    for name, (size, e) in zip(arms, ML.side_by_side([partial(run, parts) for parts in arms.values()], old.count())):
        pack = ("1.1", e.f1_macro, e.fpr, e.per_class_recall)
        champion = champion or ("1.0", *pack[1:])
        recall = [e.per_class_recall.get(c, 0.0) for c in new]
        rows.append((name, size, e.f1_macro, e.fpr, min(recall) if recall else None, None if name == "champion" else judged(base.sparkSession, pack, champion).first().verdict))
    return base.sparkSession.createDataFrame(rows, "arm string, rows long, f1_macro double, fpr double, new_recall double, verdict string")


def scenario(spark: SparkSession, root: str, corpus: DataFrame, features: list[str], window: int, config: dict, new_class: int = 5) -> DataFrame:
    """Both acts over one corpus: train without the new class, replay a stream that brings it, review, retrain, gate.

    corpus has id, query_canonical, label, and the features. One row: what happened.
    """
    rows = _kept(C.held_out_protocol(corpus, "label", new_class, "id"), f"{root}/tables/roles")
    keep = ["id", "query_canonical", "label"]
    base, golden = rows.filter("role = 'base'"), rows.filter("role = 'golden'")
    champion = train_and_seal(spark, root, base.select(*keep), None, golden.filter(F.col("label") != new_class).select(*keep), config)
    first = promote(spark, root, champion, None)
    reserve = rows.filter("role = 'reserve'")
    stream = _kept(C.replay_stream(reserve.filter("label = 0"), reserve.filter(F.col("label") > 0), rows.filter("role = 'held'"), "id", 0.2, 0.5, 0.6), f"{root}/tables/stream")
    scored = _kept(ML.classify(ML.load_model(champion["model"]), stream.withColumn("label_name", label_name(F.col("label")))), f"{root}/tables/scored")
    trigger = R.trigger(R.replay(scored, features, window, 1), 0.2, 1).first()
    confirmed = L.harvest(scored, scored).join(stream.select("id", "query_canonical", F.col("label").alias("truth")), "id").select("id", "query_canonical", F.col("truth").alias("label"), F.current_timestamp().alias("confirmed_at"))
    candidate = train_and_seal(spark, root, base.select(*keep), confirmed, golden.select(*keep), config)
    second = promote(spark, root, candidate, champion)
    return spark.createDataFrame([(first, trigger.fired, trigger.signal, candidate["rows"], second, candidate["f1_macro"])], "first string, fired boolean, signal string, rows long, second string, f1_macro double")


