"""Version ledger, training runs, and the scenarios, stopped in the middle and taken up again."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from trafficwarden.functions.features import with_features
from trafficwarden.operators import models as ML
from trafficwarden.plans import pours as P
from trafficwarden.plans import workflow as Y
from trafficwarden.plans.text_queries import tagged
from trafficwarden.sources import versions as V

CONFIG = {"vocabulary": 500, "iterations": 10}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = with_features(tagged(spark, "/root/testdata/sf0.001"), names=["length", "entropy"])
    return rows.select("id", "query_canonical", "label", F.col("length").cast("double").alias("length"), "entropy").cache()


def test_versions_follow_the_rules(spark, tmp_path):
    ledger = V.VersionLedger(spark, str(tmp_path / "v"))
    sealed = [
        ledger.seal(["normal"], 10, "h0", protected=True), ledger.seal(["normal"], 12, "h1"), ledger.seal(["normal", "stacked"], 15, "h2"), ledger.seal(["stacked"], 15, "h3"),
    ]
    assert [(e["version"], e["parent"], e["bump"]) for e in sealed] == [("1.0", None, "initial"), ("1.1", "1.0", "minor"), ("2.0", "1.1", "major"), ("2.1", "2.0", "minor")]
    with pytest.raises(ValueError, match="content already sealed"):
        ledger.seal(["normal"], 10, "h1")
    with pytest.raises(ValueError, match="unknown parent"):
        ledger.seal(["normal"], 10, "h9", parent="7.0")
    with pytest.raises(ValueError, match="version exists: 1.1"):
        ledger.seal(["normal"], 10, "h9", parent="1.0")
    with pytest.raises(ValueError, match="protected"):
        ledger.remove("1.0")
    with pytest.raises(ValueError, match="unknown version"):
        ledger.remove("9.0")
    ledger.remove("2.1")
    assert sorted(r.version for r in ledger.versions().collect()) == ["1.0", "1.1", "2.0"] and ledger.with_content("h3") is None and ledger.with_content("h1")["version"] == "1.1"
    assert [r.n for r in ledger.entries().orderBy("n").collect()] == [1, 2, 3, 4, 5]


def test_of_two_seals_at_once_one_wins(spark, tmp_path, monkeypatch):
    """Both read the same ledger; the later one checks again and follows, or is refused for the same content."""
    ledger = V.VersionLedger(spark, str(tmp_path / "v"))
    ledger.seal(["normal"], 1, "h0")
    added, waiting = V.VersionLedger._added, []

    def slow(self, entry):
        if entry["content_hash"] == "late" and not waiting:
            waiting.append(1)
            ledger.seal(["normal"], 2, "early")  # another job is first, between the check and the file
        return added(self, entry)

    monkeypatch.setattr(V.VersionLedger, "_added", slow)
    late = ledger.seal(["normal"], 3, "late")
    assert late["version"] == "1.2" and late["parent"] == "1.1" and ledger.with_content("early")["version"] == "1.1"
    monkeypatch.undo()

    def job(i):
        try:
            return ledger.seal(["normal"], i, "same")["version"]
        except ValueError as e:
            return str(e)

    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(job, range(4)))
    assert got == ["1.3"] + ["content already sealed: same"] * 3
    assert [r.n for r in ledger.entries().orderBy("n").collect()] == [1, 2, 3, 4]
    for create in (lambda p: V._renamed(spark, p, "x"), lambda p: V._linked(p, "x")):
        assert create(f"{tmp_path}/f/{id(create)}") and not create(f"{tmp_path}/f/{id(create)}")


def test_run_is_sealed_split_and_recorded(spark, corpus, tmp_path):
    root, rows = str(tmp_path), corpus.select("id", "query_canonical", "label")
    train, golden = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    one = Y.train_and_seal(spark, root, train, None, golden, CONFIG)
    two = Y.train_and_seal(spark, root, train, None, golden, CONFIG)
    assert not one["repeated"] and two["repeated"] and one["run_id"] == two["run_id"] and one["f1_macro"] > 0.8
    assert one["version"] == "1.0" and one["train_rows"] + one["valid_rows"] == one["rows"] and 0.1 < one["valid_rows"] / one["rows"] < 0.2 and one["train_ids_hash"] != one["valid_ids_hash"]
    other = Y.train_and_seal(spark, root, train, None, golden, CONFIG | {"iterations": 5})  # the same data, another run
    assert other["version"] == "1.0" and other["run_id"] != one["run_id"]
    grown = Y.train_and_seal(spark, root, train, golden.withColumn("confirmed_at", F.timestamp_seconds("id")), golden, CONFIG)
    assert grown["version"] == "1.1" and grown["bump"] == "minor"
    assert V.VersionLedger(spark, f"{root}/versions").versions().count() == 2


def test_scenario(spark, corpus, tmp_path):
    out = Y.scenario(spark, str(tmp_path), corpus, ["length", "entropy"], 50, CONFIG).first()
    assert out.first == "direct_promote" and out.second == "direct_promote" and out.rows > 0


def test_two_pours_go_on_where_they_stopped(spark, corpus, tmp_path, monkeypatch):
    options = {"features": ["length", "entropy"], "config": CONFIG, "new_class": 5, "needed": 12, "shadow": 60, "window": 20, "least": 0.0, "drop": 1.0}
    fits, fit = [], ML.fit_classifier

    def failing(df, **given):
        if len(fits) == 1:
            raise RuntimeError("lost")
        fits.append(1)
        return fit(df, **given)

    monkeypatch.setattr(ML, "fit_classifier", failing)
    with pytest.raises(RuntimeError, match="lost"):  # the first candidate is sealed, but not trained
        P.two_pours(spark, str(tmp_path), corpus, **options)
    done = []
    monkeypatch.setattr(ML, "fit_classifier", lambda df, **given: done.append(1) or fit(df, **given))
    rows = [r.asDict() for r in P.two_pours(spark, str(tmp_path), corpus, **options).collect()]
    assert len(done) == 3  # both candidates and the control, not the champion
    zero, one, two = rows
    assert zero["champion"] == zero["version"] == "1.0" and zero["new_recall"] == 0.0
    assert one["version"] == "2.0" and one["bump"] == "major" and one["comparison"] == "cross_major_refused" and one["control_recall"] == 0.0
    assert one["promoted"] and one["check_passed"] and one["champion"] == "2.0" and two["trigger_position"] > one["trigger_position"]
    assert two["version"] == "2.1" and two["bump"] == "minor" and two["comparison"] == "same_major"
    assert two["promoted"] == bool(two["verdict"] != "reject" and two["check_passed"]) and two["champion"] == ("2.1" if two["promoted"] else "2.0")
    assert [r.asDict() for r in P.two_pours(spark, str(tmp_path), corpus, **options).collect()] == rows and len(done) == 3
    assert V.VersionLedger(spark, f"{tmp_path}/versions").versions().count() == 3


def test_pours_without_a_trigger_keep_the_champion(spark, corpus, tmp_path):
    rows = P.two_pours(spark, str(tmp_path), corpus, ["length"], CONFIG, needed=100_000, window=20).collect()
    assert [r.champion for r in rows] == ["1.0"] * 3 and [r.promoted for r in rows] == [True, False, False]


def test_floor_by_hand(spark):
    prior = {"per_class_recall": {"normal": 0.95, "union_based": 0.9}}
    of = lambda **recall: {"f1_macro": 0.1, "fpr": 0.9, "per_class_recall": recall}
    assert P.floor(spark, of(normal=0.94, union_based=0.89, stacked=0.8), prior, "stacked")
    assert not P.floor(spark, of(normal=0.92, union_based=0.9, stacked=0.9), prior, "stacked")
    assert not P.floor(spark, of(normal=0.95, union_based=0.9, stacked=0.79), prior, "stacked")
    assert not P.floor(spark, of(normal=0.95, union_based=0.9), prior, "stacked")


def test_arms_are_judged(spark, corpus):
    rows = corpus.select("id", "query_canonical", "label")
    base, fresh, golden = rows.filter("label < 5 and id % 3 > 0"), rows.filter("label = 5 and id % 3 > 0"), rows.filter("id % 3 = 0")
    got = {r.arm: r for r in Y.ablation_arms(base, fresh, golden, CONFIG).collect()}
    assert got["volume_control"].new_recall == 0.0 and got["naive"].new_recall > 0.5
    assert got["champion"].verdict is None and {got[a].verdict for a in got if a != "champion"} <= {"promote", "reject"}
