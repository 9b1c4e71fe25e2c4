"""Queries of the session correlator and of saved models, over sessions of derived traffic."""

import uuid
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from trafficwarden.functions import features as X
from trafficwarden.functions import text as T
from trafficwarden.operators import curate as C
from trafficwarden.operators import decide as D
from trafficwarden.operators import estimators as E
from trafficwarden.operators import metrics as M
from trafficwarden.operators import models as ML
from trafficwarden.operators import sessions as S
from trafficwarden.operators.order import kept, shared_folder
from trafficwarden.plans.text_queries import tagged, tagged_sql

#: Kinds of sessions and their labels, apart from the labels of single queries.
KINDS = ["benign", "boolean_blind", "time_blind", "query_splitting"]
FEATURES = ["length", "special_char_ratio", "entropy", "quote_imbalance"]
STEPS = ["session_id", "step_index", "query_canonical", "session_label", "session_kind"]


def _named(rows):
    kind = F.when(F.col("label") == 0, KINDS[0]).when(F.col("label") == 3, KINDS[1]).otherwise(KINDS[2])
    week = F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")
    rows = rows.filter("label in (0, 3, 4)").withColumn("session_kind", kind)
    return rows.withColumns({"session_id": F.concat_ws("-", F.col("client").cast("string"), "session_kind", week), "session_label": F.when(F.col("label") == 0, 0).when(F.col("label") == 3, 1).otherwise(2)})


def _whole_sessions(rows):
    """Steps of a client's benign, boolean and time based queries of a week, each kind a session of its own."""
    return S.with_steps(_named(rows))


def _session_corpus(rows):
    """The same, and attacks of the other classes split over the steps of a session; with a split by session."""
    whole = _whole_sessions(rows).select(*STEPS)
    split = C.fragment_sessions(rows.filter("label in (1, 2, 5)"), "query_raw", "id")
    split = T.canonicalize(split).withColumn("session_kind", F.lit(KINDS[3])).select(*STEPS)
    return kept(C.split_by_entity(whole.unionByName(split), "session_id", 0.3))


def _traffic(s, d):
    """Tagged traffic, written once: models, sessions and tested queries are all made of it."""
    return kept(tagged(s, d).select("id", "ts", "client", "is_attack", "query_raw", "query_canonical", "label"))


def _content(rows, without=None):
    rows = rows.filter(~_tested(F.col("id")))
    return E.TextClassifier().fit(rows if without is None else rows.filter(F.col("label") != without))


def _tested(key):
    """A quarter of the single queries, by hash, is never trained on."""
    return F.conv(F.substring(C.sample_key(key), 1, 4), 16, 10).cast("int") % 4 == 0


def _detector(rows, algorithm="local_outlier_factor"):
    benign = rows.filter((F.col("label") == 0) & ~_tested(F.col("id")))
    return E.AnomalyDetector(algorithm=algorithm, features=FEATURES, logged=["length"]).fit(X.with_features(benign, names=FEATURES))


def _fitted(rows, *without):
    """The correlator, its tested steps, and a content model without each of the classes; small models are fitted at the same time."""
    jobs = [partial(_session_corpus, rows), partial(_detector, rows), partial(_content, rows), *(partial(_content, rows, c) for c in without)]
    steps, detector, content, *others = ML.side_by_side(jobs, rows.count())
    model = E.SessionCorrelator(content=content, detector=detector).fit(steps.filter("split = 'train'"))
    return model, steps.filter("split = 'test'"), *others


def _judged(s, d):
    model, steps = _fitted(_traffic(s, d))
    kinds = steps.groupBy("session_id").agg(F.max("session_kind").alias("session_kind"))
    return model.transform(steps).join(kinds, "session_id")


def _report(s, d):
    """FPR of benign sessions and detection rate of each kind, for each check and both."""
    rates = M.ablation(kept(_judged(s, d)), "session_kind", F.col("fires_content"), F.col("fires_behavior"))
    return rates.withColumn("measure", F.when(F.col("session_kind") == KINDS[0], "fpr").otherwise("detection_rate"))


def _zero_day(s, d):
    """Sessions of boolean based attacks before a content model that never saw the class, beside the one that did."""
    model, steps, never = _fitted(_traffic(s, d), 3)
    blind = kept(steps.filter(F.col("session_kind") == KINDS[1]))
    rows = [(name, E.zero_day_sessions(model, content, blind)) for name, content in (("known", model.content), ("never seen", never))]
    return rows[0][1].withColumn("content_model", F.lit(rows[0][0])).unionByName(rows[1][1].withColumn("content_model", F.lit(rows[1][0])))


def _all_checks(s, d):
    """An action for every tested query: classifier, detector and correlator, all fitted."""
    traffic = _traffic(s, d)
    model, _ = _fitted(traffic)
    rows = kept(traffic.filter(_tested(F.col("id"))))
    one = model.content.transform(rows).select("id", "client", "ts", "query_canonical", "is_sqli")
    anomaly = model.detector.transform(X.with_features(rows.select("id", "query_canonical"), names=FEATURES)).select("id", "anomaly_score", "is_anomaly")
    steps = kept(S.with_steps(S.idle_gap_sessions(one.join(anomaly, "id"), idle=21600)))
    session = model.transform(steps).select("session_id", F.col("is_attack").alias("session_attack"))
    return D.decide(steps.join(session, "session_id").withColumn("is_anomaly", F.col("is_anomaly") == 1)).select("id", "session_id", "action", "reason")


# Scores that both engines can compute, instead of fitted models.

#: Content model by rule: quotes and comment marks in the joined text of a session.
RULES = "length({t}) - length(replace({t}, '''', '')) + 2 * (length({t}) - length(replace({t}, '--', '')))"
CONTENT = f"SELECT *, round(({RULES.format(t='query_canonical')}) / (length(query_canonical) + 10), 6) AS attack_prob, CASE WHEN contains(query_canonical, 'sleep') THEN 'time_blind' ELSE 'boolean_blind' END AS predicted FROM __THIS__"


def _given(s, d):
    steps = _whole_sessions(tagged(s, d))
    score = F.round(((F.col("id") * 7919) % 1000) / 1000.0 + F.when(F.col("label") > 0, 0.3).otherwise(0.0), 6)
    steps = kept(C.split_by_entity(steps.withColumn("anomaly_score", score), "session_id", 0.3))
    return E.SessionCorrelator(content=SQLTransformer(statement=CONTENT)).fit(steps.filter("split = 'train'")), steps.filter("split = 'test'")


def _given_thresholds(s, d):
    t = _given(s, d)[0].thresholds
    return s.createDataFrame([tuple(t[n] for n in ("per_query", "mean", "fraction", "content"))], "per_query double, mean double, fraction double, content double")


def _given_verdicts(s, d):
    model, test = _given(s, d)
    return model.transform(test)


# Saved and loaded again.


def _reloaded(s, d):
    """model, rows, differing: scores of the models as fitted against those of the models as loaded."""
    root = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    rows = kept(X.with_features(tagged(s, d), names=FEATURES))
    out = []
    for name in ("local_outlier_factor", "isolation_forest", "one_class_svm"):
        model = Pipeline(stages=[E.AnomalyDetector(algorithm=name, features=FEATURES, logged=["length"])]).fit(rows.filter("label = 0"))
        model.save(f"{root}/{name}")
        again = PipelineModel.load(f"{root}/{name}").transform(rows).select("id", F.col("anomaly_score").alias("again"), F.col("is_anomaly").alias("flag"))
        same = F.col("anomaly_score").eqNullSafe(F.col("again")) & F.col("is_anomaly").eqNullSafe(F.col("flag"))
        out.append(model.transform(rows).join(again, "id").agg(F.count("*").alias("rows"), F.count_if(~same).alias("differing")).withColumn("model", F.lit(name)))
    model, test = _given(s, d)
    model.save(f"{root}/correlator")
    again = E.SessionCorrelatorModel.load(f"{root}/correlator").transform(test)
    differing = model.transform(test).exceptAll(again).agg(F.count("*").alias("differing"))
    out.append(test.agg(F.count_distinct("session_id").alias("rows")).join(F.broadcast(differing)).withColumn("model", F.lit("session_correlator")))  # one-row tables
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


QUERIES = {
    "ml14_verdicts": _all_checks,
    "ml14_session_verdicts": lambda s, d: _judged(s, d).select("session_id", "session_kind", "steps", "attack_prob", "mean_score", "fraction_above", "fires_content", "fires_behavior", "is_attack", "predicted_label"),
    "ml14_session_report": _report,
    "ml14_zero_day_sessions": _zero_day,
    "ml14_given_thresholds": _given_thresholds,
    "ml14_given_verdicts": _given_verdicts,
    "ml15_reloaded": _reloaded,
}

_STEPS = "WITH " + tagged_sql() + f""",
st AS (SELECT *, client || '-' || kind || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS session_id, round(((id * 7919) % 1000) / 1000.0::DOUBLE + CASE WHEN label > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score
  FROM (SELECT *, CASE label WHEN 0 THEN 'benign' WHEN 3 THEN 'boolean_blind' ELSE 'time_blind' END AS kind, CASE label WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS slabel FROM tagged WHERE label IN (0, 3, 4))),
joined AS (SELECT session_id, any_value(slabel) AS label, count(*) AS steps, string_agg(query_canonical, ' ' ORDER BY ts, id) AS t, CAST('0x' || sha256('0:' || session_id)[1:8] AS BIGINT) / 4294967296.0::DOUBLE < 0.3 AS tested FROM st GROUP BY session_id),
texts AS (SELECT session_id, label, steps, tested, round(({RULES.format(t='t')}) / CAST(length(t) + 10 AS DOUBLE), 6) AS attack_prob, CASE WHEN contains(t, 'sleep') THEN 'time_blind' ELSE 'boolean_blind' END AS top_label FROM joined),
lim AS (SELECT quantile_cont(score, 0.9) AS pq FROM st JOIN texts USING (session_id) WHERE NOT tested AND texts.label = 0),
cal AS (SELECT session_id, texts.label, any_value(attack_prob) AS attack_prob, round(avg(score), 6) AS m, round(avg(CAST(score > pq AS DOUBLE)), 6) AS f FROM st JOIN texts USING (session_id), lim WHERE NOT tested GROUP BY session_id, texts.label)"""


def _youden(v):
    return f"""(SELECT t FROM (SELECT t, round(avg(CAST(a.v >= t AS DOUBLE)) FILTER (a.label <> 0) - avg(CAST(a.v >= t AS DOUBLE)) FILTER (a.label = 0), 12) AS g FROM (SELECT DISTINCT {v} AS t FROM cal), (SELECT {v} AS v, label FROM cal) a GROUP BY t) ORDER BY g DESC, t LIMIT 1)"""


_THRESHOLDS = f"SELECT round(pq, 6) AS per_query, {_youden('m')} AS mean, {_youden('f')} AS fraction, {_youden('attack_prob')} AS content FROM lim"

SQL = {
    "ml14_given_thresholds": f"{_STEPS} {_THRESHOLDS}",
    "ml14_given_verdicts": f"""{_STEPS}, th AS ({_THRESHOLDS}),
per AS (SELECT session_id, any_value(texts.steps) AS steps, any_value(attack_prob) AS attack_prob, any_value(top_label) AS top_label, round(avg(score), 6) AS mean_score, round(avg(CAST(score > per_query AS DOUBLE)), 6) AS fraction_above FROM st JOIN texts USING (session_id), th WHERE tested GROUP BY session_id),
ver AS (SELECT per.*, attack_prob >= content AS fires_content, mean_score >= mean OR fraction_above >= fraction AS fires_behavior FROM per, th)
SELECT *, fires_content OR fires_behavior AS is_attack, CASE WHEN fires_content THEN top_label WHEN fires_behavior THEN 'anomalous_session' ELSE 'benign' END AS predicted_label FROM ver""",
    "ml15_reloaded": f"""{_STEPS} SELECT 'session_correlator' AS model, count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM joined WHERE tested
UNION ALL SELECT m, count(*), CAST(0 AS BIGINT) FROM events, (SELECT unnest(['local_outlier_factor', 'isolation_forest', 'one_class_svm']) AS m) GROUP BY m""",
}
