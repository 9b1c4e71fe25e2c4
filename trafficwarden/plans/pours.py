"""The run of two pours: traffic brings a new class, then more of the known ones, and the model follows.

Each step leaves a table under the root folder and is read from there once it is finished. So a driver
that is lost, or called again, goes on behind the last finished step, and no step acts twice: versions
are sealed by content, runs are known by their id, and what was promoted is a table of the step.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.functions.text import LABELS, label_name
from trafficwarden.operators import curate as C
from trafficwarden.operators import drift as R
from trafficwarden.operators import lifecycle as L
from trafficwarden.operators import metrics as M
from trafficwarden.operators import models as ML
from trafficwarden.plans import workflow as Y
from trafficwarden.sources.readers import _exists

ROWS = ["id", "query_canonical", "label"]


class Steps:
    """Named steps with a table each under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/steps/{name}"
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def facts(self, name: str, make: Callable[[], dict]) -> dict:
        found = self.table(name, lambda: self.spark.createDataFrame([(json.dumps(make(), sort_keys=True),)], "facts string"))
        return json.loads(found.first().facts)


def floor(spark: SparkSession, candidate: dict, prior: dict, new_class: str, drop: float = 0.02, least: float = 0.8) -> bool:
    """Whether a major candidate keeps the recall of every class that the prior knows, and recalls the new one."""
    known = {k: v for k, v in prior["per_class_recall"].items() if k != new_class}
    pack = ("1.1", candidate["f1_macro"], candidate["fpr"], {new_class: 0.0} | candidate["per_class_recall"])
    return Y.judged(spark, pack, ("1.0", 0.0, 1.0, known), drop=drop, new_recall=least, min_f1=0.0, max_fpr=1.0).first().verdict == "promote"


def two_pours(
    spark: SparkSession, root: str, corpus: DataFrame, features: list[str], config: dict, new_class: int = 1, needed: int = 500, shadow: int = 2000,
    window: int = 1000, confidence: float = 0.6, drop: float = 0.02, least: float = 0.8, slack: float = 0.005, seed: int = 0,
) -> DataFrame:
    """A row for each act: act, trigger_position, pool_rows, version, bump, comparison, verdict, check_passed, promoted, f1_macro, fpr, new_recall, control_recall, tail_recall, drift_signal, champion.

    corpus has id, query_canonical, label and the features. Act 0 trains the first champion without the
    new class. In act 1 the new class arrives; once ``needed`` of its flagged rows are confirmed, all
    that is confirmed so far is trained on as well. The new labels make that a major version, which
    the gate does not compare, so it must pass the floor (recall of the new class at least ``least``, none of the others down by more than ``drop``). A control with as many old rows instead
    shows whether the recall comes from the class. In act 2 known classes arrive; after ``needed``
    flagged rows a balanced pool gives a minor version, which must pass the gate and then ``shadow``
    further rows of traffic before it replaces the champion. Where a threshold isn't reached, the act
    ends without a candidate. True labels stand for the reviewer.
    """
    steps, new = Steps(spark, root), LABELS[new_class]
    roles = steps.table("roles", lambda: C.held_out_protocol(corpus, "label", new_class, "id", seed=seed))
    of = lambda role: roles.filter(F.col("role") == role).drop("role")
    base, golden = of("base").select(*ROWS), of("golden").select(*ROWS)

    def poured() -> DataFrame:
        benign = C.random_split(of("reserve").filter("label = 0"), "id", 0.25, seed, ("quiet", "rest"))
        quiet, rest = (benign.filter(F.col("split") == n).drop("split") for n in ("quiet", "rest"))
        return C.pours(quiet, of("held"), of("reserve").filter("label > 0"), rest, "id", seed).withColumn("label_name", label_name(F.col("label")))

    pour = steps.table("pour", poured)

    def scored(name: str, chunks: list[str], run: dict) -> DataFrame:
        """A pour as the model of a run sees it."""
        rows = lambda: ML.classify(ML.load_model(run["model"]), pour.filter(F.col("chunk").isin(chunks)))
        return steps.table(name, lambda: rows().select(*pour.columns, "predicted", "confidence").withColumn("flagged", (F.col("predicted") != "normal") | (F.col("confidence") < confidence)))

    def drifted(name: str, rows: DataFrame, first: int, quiet: int) -> str | None:
        """The signal that drifts first, of windows counted from a position, against the rows up to quiet."""
        def make() -> dict:
            at = rows.withColumn("position", F.col("position") - first).withColumn("phase", F.when(F.col("position") < quiet, "A").otherwise("B"))
            r = R.trigger(R.replay(at, features, window, max(1, quiet // window)), 0.2, 2).first()
            return {"signal": r.signal if r.fired else None}

        return steps.facts(name, make)["signal"]

    def confirmed(name: str, rows: DataFrame, to: int) -> DataFrame:
        """Flagged rows up to a position, with the time at which they were confirmed."""
        return steps.table(name, lambda: rows.filter(F.col("flagged") & (F.col("position") <= to)).select(*ROWS, F.timestamp_seconds("position").alias("confirmed_at")))

    def trained(name: str, pool: DataFrame, more: DataFrame | None, judge: DataFrame, parent: str | None = None) -> dict:
        return steps.facts(name, lambda: Y.train_and_seal(spark, root, pool, more, judge, config, seed, parent=parent))

    def promoted(at: int, run: dict) -> None:
        steps.table(f"promoted_{at}", lambda: spark.createDataFrame([(at, "branch1", "promote", run["version"])], "at long, branch string, action string, version string"))

    def champion(upto: int) -> str:
        """The version in production, from what the acts so far promoted."""
        paths = [f"{root}/steps/promoted_{i}" for i in range(upto + 1) if _exists(spark, f"{root}/steps/promoted_{i}/_SUCCESS")]
        return L.resolve_active(spark.read.parquet(*paths), spark.createDataFrame([("branch1", "none")], "branch string, version string")).first().version

    def recall(rows: DataFrame) -> float | None:
        return rows.filter(F.col("label") == new_class).agg(F.round(F.avg((F.col("predicted") == new).cast("double")), 6)).first()[0]

    out = []

    def told(act: int, run: dict | None, **more) -> None:
        keep = ("version", "bump", "f1_macro", "fpr")
        row = {"act": act, "new_recall": run["per_class_recall"].get(new, 0.0) if run else None} | {k: run[k] if run else None for k in keep} | more
        out.append(tuple(row.get(n) for n in NAMES))

    # act 0: the first champion never sees the new class
    first = trained("champion_0", base, None, golden.filter(F.col("label") != new_class))
    promoted(0, first)
    told(0, first, comparison="no_champion", verdict="direct_promote", promoted=True, champion=champion(0))

    # act 1: the new class arrives
    one = scored("scored_1", ["0_quiet", "1_first"], first)
    quiet = steps.facts("quiet", lambda: {"n": pour.filter("chunk = '0_quiet'").count()})["n"]
    fresh = F.col("flagged") & (F.col("label") == new_class)
    at = steps.facts("trigger_1", lambda: {"position": L.first_reaching(one, "position", fresh, needed).first().position})["position"]
    serving, pool = first, base
    if at is None:
        told(1, None, verdict="not triggered", promoted=False, drift_signal=drifted("drift_1", one, 0, quiet), champion=champion(0))
    else:
        more = confirmed("confirmed_1", one, at)
        n = steps.facts("pool_1", lambda: {"n": more.count()})["n"]
        run = trained("candidate_1", base, more, golden, first["version"])
        gate = steps.facts("gate_1", lambda: Y.judged(spark, *(tuple(r[k] for k in ("version", "f1_macro", "fpr", "per_class_recall")) for r in (run, first)), drop=drop, new_recall=least).select("comparison", "verdict").first().asDict())
        passed = steps.facts("floor_1", lambda: {"passed": floor(spark, run, first, new, drop, least)})["passed"]

        def control() -> dict:
            model = ML.fit_classifier(base.unionByName(C.reservoir(base, "id", n, seed)), **{k: config[k] for k in ("vocabulary", "iterations") if k in config})
            return {"recall": recall(ML.classify(model, golden.withColumn("label_name", label_name(F.col("label")))))}

        if passed:
            promoted(1, run)
            serving, pool = run, steps.table("pool_rows_1", lambda: L.next_training_set(base, more))
        tail = steps.facts("tail_1", lambda: {"recall": recall(ML.classify(ML.load_model(serving["model"]), pour.filter((F.col("chunk") == "1_first") & (F.col("position") > at))))})["recall"]
        told(1, run, trigger_position=at, pool_rows=n, **gate, check_passed=passed, promoted=passed, control_recall=steps.facts("control_1", control)["recall"], tail_recall=tail, drift_signal=drifted("drift_1", one, 0, quiet), champion=champion(1))

    # act 2: more of the known classes
    two = scored("scored_2", ["2_second"], serving)
    start = steps.facts("start_2", lambda: {"position": pour.filter("chunk = '2_second'").agg(F.min("position")).first()[0]})["position"]
    at = steps.facts("trigger_2", lambda: {"position": L.first_reaching(two, "position", F.col("flagged"), needed).first().position})["position"]
    signal = None if start is None else drifted("drift_2", two, start, 2 * window)
    if at is None:
        told(2, None, verdict="not triggered", promoted=False, drift_signal=signal, champion=champion(1))
        return spark.createDataFrame(out, ACTS)
    more = confirmed("confirmed_2", two, at)
    even = steps.table("balanced_2", lambda: C.balance(more, "label", "id", seed=seed).select(*more.columns))
    n = steps.facts("pool_2", lambda: {"n": even.count()})["n"]
    run = trained("candidate_2", pool, even, golden, serving["version"])
    prior = serving if serving is not first else steps.facts("prior_2", lambda: Y.evaluate_on_golden(ML.load_model(first["model"]), golden).first().asDict()) | {"version": first["version"]}
    gate = steps.facts("gate_2", lambda: Y.judged(spark, *(tuple(r[k] for k in ("version", "f1_macro", "fpr", "per_class_recall")) for r in (run, prior)), drop=drop, new_recall=least).select("comparison", "verdict").first().asDict())
    passed = None
    if gate["verdict"] != "reject":
        def shadowed() -> dict:
            rows = pour.filter((F.col("chunk") == "2_second") & (F.col("position") > at) & (F.col("position") <= at + shadow))
            seen = M.gate_evaluation(M.confusion(ML.classify(ML.load_model(run["model"]), rows)))
            r = L.shadow_gate(seen, prior["fpr"], run["f1_macro"], slack).first()
            return {"passed": bool(r and r.n_rows and r.passed)}

        passed = steps.facts("shadow_2", shadowed)["passed"]
        if passed:
            promoted(2, run)
    told(2, run, trigger_position=at, pool_rows=n, **gate, check_passed=passed, promoted=bool(passed), drift_signal=signal, champion=champion(2))
    return spark.createDataFrame(out, ACTS)


ACTS = (
    "act int, trigger_position long, pool_rows long, version string, bump string, comparison string, verdict string, check_passed boolean, promoted boolean, "
    "f1_macro double, fpr double, new_recall double, control_recall double, tail_recall double, drift_signal string, champion string"
)
NAMES = [c.split()[0] for c in ACTS.split(", ")]
