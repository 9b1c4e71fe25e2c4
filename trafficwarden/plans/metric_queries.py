"""Queries of metrics, drift, sessions, verdicts and lifecycle, over scores and keys made by arithmetic on event ids."""

from pyspark.sql import functions as F

from trafficwarden.operators import audit as A
from trafficwarden.operators import decide as D
from trafficwarden.operators import drift as R
from trafficwarden.operators import lifecycle as L
from trafficwarden.operators import metrics as M
from trafficwarden.operators import sessions as S
from trafficwarden.plans.traffic import SCORED_SQL, scored



def _attack():
    return F.col("is_attack")

CELLS = ", cells AS (SELECT label_name AS truth, predicted, count(*) AS n FROM scored GROUP BY ALL)"
REPORT = CELLS + """, labels AS (SELECT truth AS label FROM cells UNION SELECT predicted FROM cells),
rep AS (SELECT label, coalesce(sum(n) FILTER (truth = label AND predicted = label), 0) AS tp, coalesce(sum(n) FILTER (truth = label), 0) AS support, coalesce(sum(n) FILTER (predicted = label), 0) AS called FROM labels, cells GROUP BY label),
pr AS (SELECT label, support, coalesce(tp / nullif(CAST(called AS DOUBLE), 0), 0.0) AS precision, coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0.0) AS recall FROM rep),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr)"""
CURVE = ", st AS (SELECT score, sum(CAST(is_attack AS INT)) AS pos, sum(CAST(NOT is_attack AS INT)) AS neg FROM scored GROUP BY 1), cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM st)"


def _w(body, more=""):
    return f"WITH {SCORED_SQL}{more} {body}"


def _ratio(a, b):
    return f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


# Drift.

SIZE, BASE = 100, 3


def _stream(s, d):
    rows = scored(s, d)
    return rows.withColumns({"phase": F.when(F.col("position") < 400, "A").otherwise("B"), "f1": F.col("value"), "f2": F.col("score") * 10, "f3": (F.col("id") % 13).cast("double"), "f4": F.col("confidence")})


FEATURES = ["f1", "f2", "f3", "f4"]
STREAM = ", stream AS (SELECT *, position // 100 AS w, CASE WHEN position < 400 THEN 'A' ELSE 'B' END AS phase, value AS f1, score * 10 AS f2, CAST(id % 13 AS DOUBLE) AS f3, confidence AS f4, predicted <> 'normal' AS hit FROM scored)"


def _psi_sql(name, source, where_ref, feats, by="w"):
    """CTE ``name``(w, v): mean PSI of the features of each window of ``source`` against its reference rows."""
    long = " UNION ALL ".join(f"SELECT {by} AS w, position, hit, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM stream" for f in feats)
    cond_src = "hit" if source == "hit" else "true"
    return f""", {name}_l AS ({long}), {name}_r AS (SELECT feature, x FROM {name}_l WHERE {where_ref}),
{name}_q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM {name}_r GROUP BY 1),
{name}_e AS (SELECT feature, CASE WHEN len(q) > 2 THEN q[2 : len(q) - 1] ELSE [] END AS e FROM {name}_q),
{name}_b AS (SELECT feature, unnest(range(len(e) + 1)) AS b FROM {name}_e),
{name}_rc AS (SELECT r.feature, len(list_filter(e, lambda y: y <= x)) AS b, count(*) AS c FROM {name}_r r JOIN {name}_e USING (feature) GROUP BY ALL),
{name}_rf AS (SELECT b.feature, b.b, coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY b.feature) AS DOUBLE) AS ref FROM {name}_b b LEFT JOIN {name}_rc rc ON b.feature = rc.feature AND b.b = rc.b),
{name}_wc AS (SELECT l.w, l.feature, len(list_filter(e, lambda y: y <= x)) AS b, count(*) AS c FROM {name}_l l JOIN {name}_e USING (feature) WHERE {cond_src} GROUP BY ALL),
{name}_wf AS (SELECT k.w, f.feature, f.b, f.ref, coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY k.w, f.feature) AS DOUBLE) AS cur FROM (SELECT DISTINCT w, feature FROM {name}_wc) k JOIN {name}_rf f USING (feature) LEFT JOIN {name}_wc c ON c.w = k.w AND c.feature = f.feature AND c.b = f.b),
{name}_p AS (SELECT w, feature, sum((greatest(cur, 1e-6::DOUBLE) - greatest(ref, 1e-6::DOUBLE)) * ln(greatest(cur, 1e-6::DOUBLE) / greatest(ref, 1e-6::DOUBLE))) AS psi FROM {name}_wf GROUP BY ALL),
{name} AS (SELECT w, avg(psi) AS v FROM {name}_p GROUP BY w)"""


_REF = f"position < {SIZE * BASE}"
PRED = f""", sh AS (SELECT w, predicted, count(*) / CAST(sum(count(*)) OVER (PARTITION BY w) AS DOUBLE) AS cur FROM stream GROUP BY w, predicted), rs AS (SELECT predicted, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ref FROM stream WHERE {_REF} GROUP BY predicted),
gr AS (SELECT DISTINCT w, predicted FROM (SELECT w FROM sh), (SELECT predicted FROM rs) UNION SELECT w, predicted FROM sh),
pp AS (SELECT w, round(sum((greatest(coalesce(cur, 0), 1e-6::DOUBLE) - greatest(coalesce(ref, 0), 1e-6::DOUBLE)) * ln(greatest(coalesce(cur, 0), 1e-6::DOUBLE) / greatest(coalesce(ref, 0), 1e-6::DOUBLE))), 6) AS v FROM gr LEFT JOIN sh USING (w, predicted) LEFT JOIN rs USING (predicted) GROUP BY w)"""
REPLAY = STREAM + _psi_sql("pg", "all", _REF, FEATURES) + _psi_sql("pa", "hit", _REF + " AND hit", FEATURES) + PRED + _psi_sql("pc", "all", _REF, ["confidence"]) + _psi_sql("po", "hit", _REF + " AND hit", ["confidence"]) + f"""
, bw AS (SELECT w, min(phase) AS phase, max(position) < {SIZE * BASE} AS is_reference, count(*) AS n, count(*) FILTER (hit) AS flagged, round(avg(CAST(hit AS DOUBLE)), 6) AS block, round(avg(CAST(confidence < 0.6 AS DOUBLE)), 6) AS low_confidence, round(avg(confidence), 6) AS mean_confidence FROM stream GROUP BY w)
, win0 AS (SELECT w AS "window", phase, is_reference, n, round(coalesce(pg.v, 0), 6) AS "global", round(CASE WHEN flagged >= 5 THEN coalesce(pa.v, 0) ELSE 0 END, 6) AS attack_subpop, round(coalesce(pp.v, 0), 6) AS prediction, round(coalesce(pc.v, 0), 6) AS confidence, round(CASE WHEN flagged >= 5 THEN coalesce(po.v, 0) ELSE 0 END, 6) AS confidence_flagged, block, low_confidence, mean_confidence
FROM bw LEFT JOIN pg USING (w) LEFT JOIN pa USING (w) LEFT JOIN pp USING (w) LEFT JOIN pc USING (w) LEFT JOIN po USING (w))
, win AS (SELECT *, greatest("global", attack_subpop, prediction, confidence, confidence_flagged) >= 0.2 AS alert FROM win0)"""
LONGWIN = REPLAY + ", lw AS (" + " UNION ALL ".join(f"SELECT \"window\", phase, is_reference, {i} AS priority, '{x}' AS signal, \"{x}\" AS v FROM win" for i, x in enumerate(R.SIGNALS)) + ")"


def _windows(s, d):
    return R.replay(_stream(s, d), FEATURES, SIZE, BASE)


def _reference(s, d):
    return R.fit_reference(R.long_features(_stream(s, d).filter(F.col("position") < 300), FEATURES, []))


def _all_fractions(s, d):
    """Shares of all windows, where every third window's values have not arrived."""
    rows = _stream(s, d).withColumn("w", R.count_window("position", SIZE))
    values = R.long_features(rows, FEATURES, ["w"]).withColumn("x", F.when(F.col("w") % 3 != 2, F.col("x")))
    found = R.fractions_of_all(values, _reference(s, d), rows.select("w"), ["w"])
    return found.select("w", "feature", "n", F.round(F.get("cur", F.lit(0)), 6).alias("first_share"))


def _numeric_drift(s, d, metric="psi"):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.lit("l_quantity").alias("feature"), F.col("l_quantity").cast("double").alias("x"), F.year("l_shipdate").alias("year"))
    return R.psi(rows, R.fit_reference(rows.filter("year = 1997")), ["year"], metric=metric)


def _numeric_sql(term, name):
    return f"""WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS x, year(l_shipdate) AS year FROM lineitem), q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM l WHERE year = 1997), e AS (SELECT q[2 : len(q) - 1] AS e FROM q),
c AS (SELECT year, len(list_filter(e, lambda y: y <= x)) AS b, count(*) AS c FROM l, e GROUP BY ALL), g AS (SELECT year, unnest(range(len(e) + 1)) AS b FROM (SELECT DISTINCT year FROM l), e),
f AS (SELECT g.year, g.b, coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY g.year) AS DOUBLE) AS cur, sum(coalesce(c, 0)) OVER (PARTITION BY g.year) AS n FROM g LEFT JOIN c USING (year, b)), r AS (SELECT b, cur AS ref FROM f WHERE year = 1997),
z AS (SELECT year, n, greatest(cur, 1e-6::DOUBLE) AS a, greatest(ref, 1e-6::DOUBLE) AS d FROM f JOIN r USING (b))
SELECT year, 'l_quantity' AS feature, CAST(max(n) AS BIGINT) AS n, round(sum({term}), 6) AS {name} FROM z GROUP BY year"""


# Sessions.


def _sessions(s, d, idle=21600):
    return S.with_steps(S.idle_gap_sessions(scored(s, d), idle=idle))


def _sess_sql(idle=21600):
    return f""", s1 AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER c <= {idle * 1000000} THEN 0 ELSE 1 END AS nw FROM scored WINDOW c AS (PARTITION BY client ORDER BY ts, id)),
s2 AS (SELECT *, client || '-' || CAST(sum(nw) OVER (PARTITION BY client ORDER BY ts, id) AS BIGINT) AS session_id FROM s1),
sess AS (SELECT * EXCLUDE (nw), CAST(row_number() OVER z - 1 AS INTEGER) AS step_index, coalesce(round((epoch_us(ts) - lag(epoch_us(ts)) OVER z) / 1000000.0::DOUBLE, 6), 0.0) AS gap_seconds FROM s2 WINDOW z AS (PARTITION BY session_id ORDER BY ts, id))"""


def _session_rows(s, d):
    steps = _sessions(s, d)
    per = S.behaviour(steps, 0.8)
    more = steps.groupBy("session_id").agg(F.max("label").alias("label"), F.round(F.max("confidence"), 6).alias("attack_prob"), F.max_by("label_name", F.struct("label", "id")).alias("top_label"))
    return per.join(more, "session_id")


SROWS = _sess_sql() + ", srows AS (SELECT session_id, count(*) AS steps, round(avg(score), 6) AS mean_score, round(avg(CAST(score > 0.8 AS DOUBLE)), 6) AS fraction_above, max(label) AS label, round(max(confidence), 6) AS attack_prob, arg_max(label_name, label * 10000000 + id) AS top_label FROM sess GROUP BY session_id)"
VERDICT = SROWS + ", ver AS (SELECT *, attack_prob >= 0.9 AS fires_content, mean_score >= 0.75 OR fraction_above >= 0.6 AS fires_behavior FROM srows)"


def _calibrated(s, d):
    steps = _sessions(s, d)
    return S.calibrate(steps.select("session_id", "score"), _session_rows(s, d).select("session_id", "label", "attack_prob"))


def _youden_sql(v):
    return f"""(SELECT t FROM (SELECT t, round(avg(CAST(a.v >= t AS DOUBLE)) FILTER (a.label <> 0) - avg(CAST(a.v >= t AS DOUBLE)) FILTER (a.label = 0), 12) AS g FROM (SELECT DISTINCT {v} AS t FROM cal), (SELECT {v} AS v, label FROM cal) a GROUP BY t) ORDER BY g DESC, t LIMIT 1)"""


def _decisions(s, d):
    i = F.col("id")
    return D.decide(scored(s, d).select("id", F.when(i % 11 != 0, F.col("predicted") != "normal").alias("is_sqli"), F.when(i % 5 != 0, F.col("score") > 0.9).alias("is_anomaly"), F.when(i % 3 != 0, i % 17 == 0).alias("session_attack")))


DECIDE = ", dd AS (SELECT id, CASE WHEN id % 11 <> 0 THEN predicted <> 'normal' END AS q, CASE WHEN id % 5 <> 0 THEN score > 0.9 END AS a, CASE WHEN id % 3 <> 0 THEN id % 17 = 0 END AS s FROM scored)"


# Lifecycle.


def _items(s, d):
    rows = scored(s, d).filter("predicted <> 'normal' or confidence < 0.6")
    return rows.select("id", F.col("ts").alias("created_at"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_canonical"), F.when(F.col("id") % 9 != 0, F.col("predicted")).alias("ai_label"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("round_id"))


def _decided(s, d):
    i = F.col("id")
    asked = scored(s, d).select((i + F.when(i % 50 == 0, 1_000_000).otherwise(0)).alias("id"), F.when(i % 4 == 0, "approve").when(i % 4 == 1, "correct").when(i % 4 == 2, "reject").otherwise("other").alias("action"), F.when(i % 8 != 1, F.col("label_name")).alias("label"), F.col("ts").alias("decided_at"))
    return L.decide_items(_items(s, d), asked)


ITEMS = ", items AS (SELECT id, ts AS created_at, 'q' || id AS query_canonical, CASE WHEN id % 9 <> 0 THEN predicted END AS ai_label, 'r' || (id % 3) AS round_id FROM scored WHERE predicted <> 'normal' OR confidence < 0.6)"
DECIDED = ITEMS + """, asked AS (SELECT id + CASE WHEN id % 50 = 0 THEN 1000000 ELSE 0 END AS id, CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' ELSE 'other' END AS action, CASE WHEN id % 8 <> 1 THEN label_name END AS label, ts AS decided_at FROM scored),
dj AS (SELECT a.*, i.ai_label, i.query_canonical, i.round_id, CASE WHEN i.id IS NULL THEN 'unknown id' WHEN action = 'other' THEN 'unknown action' WHEN action = 'correct' AND label IS NULL THEN 'label missing' WHEN action = 'approve' AND ai_label IS NULL THEN 'no pre-label' END AS error FROM asked a LEFT JOIN items i USING (id)),
dec AS (SELECT id, query_canonical, round_id, ai_label, CASE WHEN action = 'reject' THEN 'rejected' WHEN action = 'approve' OR label = ai_label THEN 'approved' ELSE 'corrected' END AS status, CASE action WHEN 'reject' THEN NULL WHEN 'approve' THEN ai_label ELSE label END AS final_label FROM dj WHERE error IS NULL)"""
ID = "CAST(list_position(['normal', 'union_based', 'error_based', 'boolean_blind', 'time_blind', 'stacked'], {}) - 1 AS INTEGER)"


def _evaluations(s, d):
    """An evaluation for each client group as a model's."""
    rows = scored(s, d).withColumn("model", (F.col("client") % 6).cast("int"))
    base = rows.groupBy("model").agg(F.round(F.mean((F.col("label_name") == F.col("predicted")).cast("double")), 6).alias("f1_macro"), F.round(F.mean(F.when(F.col("label") == 0, (F.col("predicted") != "normal").cast("double"))), 6).alias("fpr"))
    recall = rows.filter((F.col("label") < 5) | (F.col("model") % 2 == 1)).groupBy("model", "label_name").agg(F.round(F.mean((F.col("label_name") == F.col("predicted")).cast("double")), 6).alias("r")).groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("label_name", "r"))).alias("per_class_recall"))
    return base.join(recall, "model").withColumn("data_version", F.when(F.col("model") == 5, "2.0").otherwise(F.concat(F.lit("1."), F.col("model").cast("string"))))


def _gate(s, d):
    e = _evaluations(s, d)
    pack = lambda n: e.select(F.col("model").alias(f"m_{n}"), F.struct("data_version", "f1_macro", "fpr", "per_class_recall").alias(n))
    pairs = pack("candidate").join(pack("champion"), F.col("m_champion") == F.col("m_candidate") - 1, "left")
    return L.gate(pairs).select(F.col("m_candidate").alias("model"), "verdict", "comparison", F.array_join("regressions", ",").alias("regressions"), F.array_join("weak_new", ",").alias("weak_new"), "f1_ok", "fpr_ok")


EVAL = """, ev AS (SELECT *, client % 6 AS model FROM scored), eb AS (SELECT model, round(avg(CAST(label_name = predicted AS DOUBLE)), 6) AS f1, round(avg(CASE WHEN label = 0 THEN CAST(predicted <> 'normal' AS DOUBLE) END), 6) AS fpr FROM ev GROUP BY 1),
er AS (SELECT model, label_name, round(avg(CAST(label_name = predicted AS DOUBLE)), 6) AS r FROM ev WHERE label < 5 OR model % 2 = 1 GROUP BY ALL)"""
GATE = EVAL + """, gp AS (SELECT c.model, c.f1, c.fpr, h.model IS NULL AS none, CASE WHEN c.model = 5 THEN '2' ELSE '1' END <> CASE WHEN h.model = 5 THEN '2' ELSE '1' END AS other, c.f1 >= h.f1 AS f1_ok, c.fpr <= h.fpr AS fpr_ok FROM eb c LEFT JOIN eb h ON h.model = c.model - 1),
gl AS (SELECT h.model + 1 AS model, string_agg(h.label_name, ',' ORDER BY h.label_name) AS lost FROM er h LEFT JOIN er c ON c.model = h.model + 1 AND c.label_name = h.label_name WHERE round(h.r - coalesce(c.r, 0), 6) > 0.02 GROUP BY 1),
gw AS (SELECT c.model, string_agg(c.label_name, ',' ORDER BY c.label_name) AS weak FROM er c LEFT JOIN er h ON h.model = c.model - 1 AND c.label_name = h.label_name WHERE h.model IS NULL AND c.r < 0.8 GROUP BY 1),
gg AS (SELECT *, none OR other AS skip FROM gp LEFT JOIN gl USING (model) LEFT JOIN gw USING (model))"""


def _events(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select(k.alias("at"), F.concat(F.lit("b"), (F.col("o_custkey") % 9).cast("string")).alias("branch"), F.when(k % 7 == 0, "rollback").when(k % 31 == 0, "clear").otherwise("promote").alias("action"), F.concat(F.lit("v"), k.cast("string")).alias("version"))


def _active(events):
    return L.resolve_active(events, events.select("branch").distinct().withColumn("version", F.lit("base")))


def _versions(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    return n.select(F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("version"), F.array(F.lit("normal"), F.lit("union_based")).alias("label_space"), F.md5("n_name").alias("content_hash"), (F.col("n_nationkey") < 3).alias("protected"))


def _seal(s, d):
    c = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.concat((F.col("s_nationkey") % 6 + 1).cast("string"), F.lit("."), F.col("s_nationkey").cast("string")).alias("parent"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("normal"), F.lit("stacked"))).otherwise(F.array(F.lit("normal"))).alias("label_space"), F.md5(F.col("s_suppkey").cast("string")).alias("content_hash"))
    return L.seal(_versions(s, d), c).select("parent", "content_hash", "bump", "version", F.array_join("new_classes", ",").alias("new_classes"), "error")


_V = "ver AS (SELECT (n_regionkey + 1) || '.' || n_nationkey AS version FROM nation)"

#: The stage log of each branch folded in order: z is (latest version f, the one before it s, live).
FOLDED = """WITH e AS (SELECT o_orderkey AS k, 'b' || (o_custkey % 9) AS branch, CASE WHEN o_orderkey % 7 = 0 THEN 'rollback' WHEN o_orderkey % 31 = 0 THEN 'clear' ELSE 'promote' END AS a, 'v' || o_orderkey AS v FROM orders),
l AS (SELECT branch, list_prepend({'f': NULL::VARCHAR, 's': NULL::VARCHAR, 'live': false, 'a': '', 'v': ''}, list({'f': NULL::VARCHAR, 's': NULL::VARCHAR, 'live': false, 'a': a, 'v': v} ORDER BY k)) AS l FROM e GROUP BY branch),
r AS (SELECT branch, list_reduce(l, lambda p, x: {
  'f': CASE WHEN x.a = 'promote' THEN x.v WHEN x.a = 'rollback' AND p.live AND p.s IS NOT NULL THEN p.s ELSE p.f END,
  's': CASE WHEN x.a = 'promote' THEN CASE WHEN x.v = p.f THEN p.s ELSE p.f END WHEN x.a = 'rollback' AND p.live AND p.s IS NOT NULL THEN p.f ELSE p.s END,
  'live': CASE WHEN x.a = 'promote' THEN true WHEN x.a = 'clear' THEN false ELSE p.f IS NOT NULL END, 'a': '', 'v': ''}) AS z FROM l)
"""

QUERIES = {
    "a20_confusion": lambda s, d: M.confusion(scored(s, d)),
    "a21_class_report": lambda s, d: M.class_report(M.confusion(scored(s, d))).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"),
    "a21_summary": lambda s, d: M.summary(M.confusion(scored(s, d))),
    "a22_gate_evaluation": lambda s, d: M.gate_evaluation(M.confusion(scored(s, d))).select(F.round("f1_macro", 6).alias("f1_macro"), F.round("fpr", 6).alias("fpr"), F.round(F.element_at("per_class_recall", "stacked"), 6).alias("stacked_recall"), "n_rows"),
    "a23_roc": lambda s, d: M.roc(scored(s, d), "score", _attack()),
    "a23_auc": lambda s, d: M.auc(scored(s, d), "score", _attack()),
    "a24_thinned_roc": lambda s, d: M.thinned(M.roc(scored(s, d), "score", _attack()), "threshold").select("threshold", "fpr", "tpr"),
    "a25_precision_recall": lambda s, d: M.precision_recall(scored(s, d), "score", _attack()),
    "a25_average_precision": lambda s, d: M.average_precision(scored(s, d), "score", _attack()),
    "a26_detector": lambda s, d: M.detector_report(scored(s, d), F.col("score") > 0.7, _attack()),
    "a27_matched_fpr": lambda s, d: M.matched_fpr(scored(s, d), "score", _attack()),
    "a28_threshold_sweep": lambda s, d: M.threshold_sweep(scored(s, d), "score", _attack()),
    "a29_rate_by_source": lambda s, d: M.rate_by(scored(s, d), "source", F.col("score") > 0.7),
    "a30_ks": lambda s, d: M.ks_statistic(scored(s, d), "score", _attack()),
    "a31_youden": lambda s, d: M.youden(scored(s, d), "score", _attack()),
    "a32_zero_day": lambda s, d: M.zero_day(scored(s, d), "label_name", "predicted", F.col("score") > 0.8).withColumn("predictions", F.array_join(F.array_sort(F.transform(F.map_entries("predictions"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")),
    "a33_ablation": lambda s, d: M.ablation(scored(s, d), "label_name", F.col("score") > 0.9, F.col("confidence") > 0.9),
    "a34_shadow": lambda s, d: M.shadow_report(scored(s, d), scored(s, d).withColumn("predicted", F.when(F.col("id") % 13 == 0, F.lit("normal")).otherwise(F.col("predicted")))),
    "a40_reference_bins": lambda s, d: _reference(s, d).select("feature", F.size("edges").alias("edges"), F.round(F.get("edges", F.lit(0)), 6).alias("first"), F.round(F.array_max("edges"), 6).alias("last")),
    "a41_fractions": lambda s, d: R.fractions(R.long_features(_stream(s, d).withColumn("w", R.count_window("position", SIZE)), FEATURES, ["w"]), _reference(s, d), ["w"]).select("w", "feature", "n", F.round(F.get("cur", F.lit(0)), 6).alias("first_share")),
    "a41_empty_windows": _all_fractions,
    "a42_psi": lambda s, d: _numeric_drift(s, d),
    "a47_kl": lambda s, d: _numeric_drift(s, d, "kl"),
    "a43_categorical_psi": lambda s, d: R.psi_categorical(R.shares(_stream(s, d).withColumn("w", R.count_window("position", SIZE)), ["w"], "predicted"), R.shares(_stream(s, d).filter("position < 300"), [], "predicted"), ["w"], "predicted"),
    "a44_bands": lambda s, d: _numeric_drift(s, d).select("year", R.band(F.col("psi"), 0.2).alias("band")),
    "a45_replay": _windows,
    "a46_phase_summary": lambda s, d: R.phase_summary(_windows(s, d)).drop("ratio"),
    "a48_strongest": lambda s, d: R.strongest(_windows(s, d)),
    "w7_trigger": lambda s, d: R.trigger(_windows(s, d), 0.05, 2),
    "w3_windows": lambda s, d: scored(s, d).groupBy(R.count_window("position", 300).alias("w")).agg(F.count("*").alias("n")),
    "w10_reference_windows": lambda s, d: scored(s, d).groupBy(R.count_window("position", SIZE).alias("w")).agg((F.max("position") < SIZE * BASE).alias("is_reference")),
    "w4_w5_steps": lambda s, d: _sessions(s, d).select("id", "session_id", "step_index", "gap_seconds"),
    "w12_sessions_30min": lambda s, d: _sessions(s, d, 1800).groupBy("session_id").agg(F.count("*").alias("steps")),
    "w12_given_sessions": lambda s, d: S.idle_gap_sessions(scored(s, d).withColumn("known", F.when(F.col("client") % 5 == 0, F.concat(F.lit("s"), F.col("client") % 10))), given="known").select("id", "session_id"),
    "a13_session_meta": lambda s, d: A.session_meta(_sessions(s, d).select("session_id", "step_index", F.col("label_name").alias("session_label"), F.col("source").alias("session_source"), F.when(F.col("position") < 400, "early").otherwise("late").alias("split"))),
    "a50_a51_collected": lambda s, d: S.collected(_sessions(s, d), "label_name").select("session_id", F.size("steps").alias("steps"), "session_text"),
    "a52_behaviour": lambda s, d: S.behaviour(_sessions(s, d), 0.8),
    "a53_verdict": lambda s, d: S.verdict(_session_rows(s, d), 0.9, 0.75, 0.6).select("session_id", "fires_content", "fires_behavior", "is_attack", "predicted_label"),
    "a54_calibrate": _calibrated,
    "g1_decide": lambda s, d: _decisions(s, d).select("id", "action"),
    "g2_worst_step": lambda s, d: D.worst_step(_sessions(s, d).withColumn("is_sqli", F.col("predicted") != "normal"), keep=["is_sqli", "id"]),
    "q7_hold_outcome": lambda s, d: scored(s, d).select("id", D.hold_outcome(F.when(F.col("id") % 4 == 0, F.lit("approved")), F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("outcome")),
    "q1_enqueue": lambda s, d: L.enqueue(_items(s, d).filter("id % 2 = 0"), _items(s, d).filter("id % 3 = 0").unionByName(_items(s, d).filter("id % 6 = 3")), order=["created_at"]).select("id"),
    "q2_decided": lambda s, d: _decided(s, d)[0].select("id", "status", "final_label"),
    "q2_errors": lambda s, d: _decided(s, d)[1],
    "q3_counts": lambda s, d: L.queue_counts(L.queue_state(_items(s, d), _decided(s, d)[0])),
    "q4_confirmed": lambda s, d: L.confirmed_rows(_decided(s, d)[0]).select("id", "label", "label_id", "was_corrected"),
    "q5_without_round": lambda s, d: L.without_round(_items(s, d), "r1").select("id"),
    "q6_harvest": lambda s, d: L.harvest(scored(s, d), scored(s, d)).select("id", "ai_label", "label", "was_corrected"),
    "l1_page": lambda s, d: L.page(L.queue_state(_items(s, d), _decided(s, d)[0]), "pending", 20, 10).select("id"),
    "l3_newest": lambda s, d: L.newest_first(_items(s, d), "created_at", 25).select("id"),
    "w6_first_reaching": lambda s, d: L.first_reaching(scored(s, d), "position", F.col("label") == 5, 20, F.floor(F.col("position") / 100)),
    "w11_latest_version": lambda s, d: L.latest_version(_versions(s, d)).select("version", "content_hash"),
    "g3_gate": _gate,
    "g4_quality_floor": lambda s, d: L.quality_floor(_evaluations(s, d), 0.84, 0.15, 0.8).select("model", "passed", F.array_join("failing", ",").alias("failing")),
    "g5_shadow_gate": lambda s, d: L.shadow_gate(M.gate_evaluation(M.confusion(scored(s, d).orderBy("position").limit(500))), 0.14, 0.9).select("n_rows", "passed"),
    "g6_content_hash": lambda s, d: L.content_hash(scored(s, d), "id", "label"),
    "g8_seal": _seal,
    "g9_stages": lambda s, d: L.stages(_events(s, d)).groupBy("branch", "stage").agg(F.count("*").alias("n")),
    "g9_resolve_active": lambda s, d: _active(_events(s, d)),
    "g10_training_set": lambda s, d: L.next_training_set(scored(s, d).filter("id % 2 = 0").select("id", F.concat(F.lit("t"), (F.col("id") % 97).cast("string")).alias("query_canonical"), "label"), scored(s, d).filter("id % 2 = 1 and label > 0").select("id", F.concat(F.lit("t"), (F.col("id") % 89).cast("string")).alias("query_canonical"), "label", F.col("ts").alias("confirmed_at"))),
    "u2_golden": lambda s, d: L.with_new_class(scored(s, d).filter("id % 4 = 0"), scored(s, d).filter("id % 6 = 0")).select("id"),
    "u4_new_classes": lambda s, d: _versions(s, d).select("version", F.array_join(L.next_version(F.col("version"), F.array(F.lit("normal")), F.col("label_space"))["new_classes"], ",").alias("new_classes")),
}

_G1 = "CASE WHEN coalesce(s, false) THEN 'BLOCK' WHEN q IS NULL THEN 'UNKNOWN' WHEN q THEN 'BLOCK' WHEN coalesce(a, false) THEN 'OVERKILL' ELSE 'ALLOW' END"
SQL = {
    "a20_confusion": _w("SELECT * FROM cells", CELLS),
    "a21_class_report": _w("SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f", REPORT),
    "a21_summary": _w("SELECT round(sum(n) FILTER (truth = predicted) / CAST(sum(n) AS DOUBLE), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n, (SELECT round(avg(f1), 6) FROM f) AS f1_macro FROM cells", REPORT),
    "a22_gate_evaluation": _w("SELECT (SELECT round(avg(f1), 6) FROM f WHERE support > 0) AS f1_macro, round(sum(n) FILTER (truth = 'normal' AND predicted <> 'normal') / CAST(sum(n) FILTER (truth = 'normal') AS DOUBLE), 6) AS fpr, (SELECT round(recall, 6) FROM f WHERE label = 'stacked') AS stacked_recall, CAST(sum(n) AS BIGINT) AS n_rows FROM cells", REPORT),
    "a23_roc": _w("SELECT score AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM cv", CURVE),
    "a23_auc": _w("SELECT round((sum(rk) FILTER (is_attack) - np * (np + 1) / 2.0::DOUBLE) / (np * nn), 6) AS auc FROM (SELECT is_attack, avg(k) OVER (PARTITION BY score) AS rk, count(*) FILTER (is_attack) OVER () AS np, count(*) FILTER (NOT is_attack) OVER () AS nn FROM (SELECT *, CAST(row_number() OVER (ORDER BY score) AS DOUBLE) AS k FROM scored)) GROUP BY np, nn"),
    "a24_thinned_roc": _w("SELECT threshold, fpr, tpr FROM (SELECT score AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr, row_number() OVER (ORDER BY score) - 1 AS k, greatest(ceil(count(*) OVER () / 50.0::DOUBLE), 1) AS m FROM cv) WHERE k % m = 0", CURVE),
    "a25_precision_recall": _w("SELECT score AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall FROM cv", CURVE),
    "a25_average_precision": _w("SELECT round(sum(pos / CAST(p AS DOUBLE) * tp / (tp + fp)), 6) AS average_precision FROM cv", CURVE),
    "a26_detector": _w("SELECT count(*) FILTER (is_attack AND f) AS tp, count(*) FILTER (NOT is_attack AND f) AS fp, count(*) FILTER (NOT is_attack AND NOT f) AS tn, count(*) FILTER (is_attack AND NOT f) AS fn, round(avg(CAST(f AS DOUBLE)) FILTER (NOT is_attack), 6) AS fpr, round(avg(CAST(f AS DOUBLE)) FILTER (is_attack), 6) AS detection_rate FROM (SELECT *, score > 0.7 AS f FROM scored)"),
    "a27_matched_fpr": _w("SELECT round(t, 6) AS threshold, round(avg(CAST(score > t AS DOUBLE)) FILTER (NOT is_attack), 6) AS fpr, round(avg(CAST(score > t AS DOUBLE)) FILTER (is_attack), 6) AS detection_rate FROM scored, (SELECT quantile_cont(score, 0.95) AS t FROM scored WHERE NOT is_attack) GROUP BY t"),
    "a28_threshold_sweep": _w(f"SELECT round(threshold, 6) AS threshold, fp, tp, tn, fn, fpr, detection_rate, precision FROM (SELECT threshold, count(*) FILTER (NOT is_attack AND f) AS fp, count(*) FILTER (is_attack AND f) AS tp, count(*) FILTER (NOT is_attack AND NOT f) AS tn, count(*) FILTER (is_attack AND NOT f) AS fn, round(avg(CAST(f AS DOUBLE)) FILTER (NOT is_attack), 6) AS fpr, round(avg(CAST(f AS DOUBLE)) FILTER (is_attack), 6) AS detection_rate, coalesce(round(count(*) FILTER (is_attack AND f) / nullif(CAST(count(*) FILTER (f) AS DOUBLE), 0), 6), 0.0) AS precision FROM (SELECT is_attack, t AS threshold, score > t AS f FROM scored, (SELECT DISTINCT unnest(list_concat(quantile_cont(score, {[p / 100 for p in M.SWEPT]}), [0.0, min(score), max(score)])) AS t FROM scored)) GROUP BY threshold)"),
    "a29_rate_by_source": _w("SELECT source, count(*) AS n, round(avg(CAST(score > 0.7 AS DOUBLE)), 6) AS rate FROM scored GROUP BY 1"),
    "a30_ks": _w("SELECT round(max(abs(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE))), 6) AS ks FROM cv", CURVE),
    "a31_youden": _w("SELECT score AS threshold, round(g, 6) AS gain FROM (SELECT score, round(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE), 12) AS g FROM cv) ORDER BY g DESC, score LIMIT 1", CURVE),
    "a32_zero_day": _w("SELECT label_name, count(*) AS n, round(avg(CAST(predicted = 'normal' AS DOUBLE)), 6) AS miss_rate, round(avg(CAST(score > 0.8 AS DOUBLE)), 6) AS detection_rate, round(avg(CAST(predicted <> 'normal' OR score > 0.8 AS DOUBLE)), 6) AS covered, (SELECT string_agg(predicted || ':' || c, ',' ORDER BY predicted) FROM (SELECT predicted, count(*) AS c FROM scored b WHERE b.label_name = a.label_name GROUP BY 1)) AS predictions FROM scored a WHERE label_name <> 'normal' GROUP BY label_name"),
    "a33_ablation": _w(" UNION ALL ".join(f"SELECT '{m}' AS method, label_name, count(*) AS n, round(avg(CAST({c} AS DOUBLE)), 6) AS rate FROM scored GROUP BY 2" for m, c in (("content", "score > 0.9"), ("behaviour", "confidence > 0.9"), ("combined", "(score > 0.9 OR confidence > 0.9)")))),
    "a34_shadow": _w("SELECT count(*) AS n, round(avg(CAST(predicted = b AS DOUBLE)), 6) AS agreement, count(*) FILTER (predicted <> 'normal' AND b = 'normal') AS candidate_allows, count(*) FILTER (predicted = 'normal' AND b <> 'normal') AS candidate_blocks, round(avg(CAST(predicted <> 'normal' AS DOUBLE)), 6) AS champion_block_rate, round(avg(CAST(b <> 'normal' AS DOUBLE)), 6) AS candidate_block_rate FROM (SELECT *, CASE WHEN id % 13 = 0 THEN 'normal' ELSE predicted END AS b FROM scored)"),
    "a40_reference_bins": _w("SELECT feature, CAST(len(e) AS INTEGER) AS edges, round(e[1], 6) AS first, round(list_max(e), 6) AS last FROM pg_e", STREAM + _psi_sql("pg", "all", _REF, FEATURES)),
    "a41_fractions": _w("SELECT w, feature, n, round(cur, 6) AS first_share FROM pg_wf JOIN (SELECT w, feature, CAST(sum(c) AS BIGINT) AS n FROM pg_wc GROUP BY ALL) USING (w, feature) WHERE b = 0", STREAM + _psi_sql("pg", "all", _REF, FEATURES)),
    "a41_empty_windows": _w("SELECT w, feature, CASE WHEN w % 3 = 2 THEN 0 ELSE n END AS n, round(CASE WHEN w % 3 = 2 THEN 1 / CAST(bins AS DOUBLE) ELSE cur END, 6) AS first_share FROM pg_wf JOIN (SELECT w, feature, CAST(sum(c) AS BIGINT) AS n FROM pg_wc GROUP BY ALL) USING (w, feature) JOIN (SELECT feature, count(*) AS bins FROM pg_b GROUP BY 1) USING (feature) WHERE b = 0", STREAM + _psi_sql("pg", "all", _REF, FEATURES)),
    "a42_psi": _numeric_sql("(a - d) * ln(a / d)", "psi"),
    "a47_kl": _numeric_sql("a * ln(a / d)", "kl"),
    "a43_categorical_psi": _w("SELECT w, v AS psi FROM pp", STREAM + PRED),
    "a44_bands": "SELECT year, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END AS band FROM (" + _numeric_sql("(a - d) * ln(a / d)", "psi") + ")",
    "a45_replay": _w("SELECT * FROM win", REPLAY),
    "a46_phase_summary": _w("SELECT signal, round(avg(v) FILTER (phase = 'A' AND NOT is_reference), 6) AS mean_a, max(v) FILTER (phase = 'A' AND NOT is_reference) AS max_a, round(avg(v) FILTER (phase = 'B'), 6) AS mean_b, max(v) FILTER (phase = 'B') AS max_b, coalesce(max(v) FILTER (phase = 'A' AND NOT is_reference) < 0.2, true) AS quiet_in_a, coalesce(max(v) FILTER (phase = 'B') >= 0.2, false) AS fired_in_b FROM lw GROUP BY 1", LONGWIN),
    "a48_strongest": _w("SELECT \"window\", phase, is_reference, signal, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY \"window\" ORDER BY v DESC, priority) AS k FROM lw) WHERE k = 1", LONGWIN),
    "w7_trigger": _w("SELECT count(*) > 0 AS fired, arg_min(\"window\", \"window\" * 10 + priority) AS window_index, arg_min(signal, \"window\" * 10 + priority) AS signal FROM (SELECT *, v >= 0.05 AND lag(v) OVER (PARTITION BY priority ORDER BY \"window\") >= 0.05 AS f FROM lw) WHERE f", LONGWIN),
    "w3_windows": _w("SELECT position // 300 AS w, count(*) AS n FROM scored GROUP BY 1"),
    "w10_reference_windows": _w("SELECT position // 100 AS w, max(position) < 300 AS is_reference FROM scored GROUP BY 1"),
    "w4_w5_steps": _w("SELECT id, session_id, step_index, gap_seconds FROM sess", _sess_sql()),
    "w12_sessions_30min": _w("SELECT session_id, count(*) AS steps FROM sess GROUP BY 1", _sess_sql(1800)),
    "w12_given_sessions": _w("SELECT id, CASE WHEN client % 5 = 0 THEN 's' || client % 10 ELSE session_id END AS session_id FROM sess", _sess_sql(1800)),
    "a13_session_meta": _w("SELECT session_id, count(*) AS steps, arg_min(label_name, step_index) AS session_label, arg_min(source, step_index) AS session_source, CASE WHEN arg_min(position, step_index) < 400 THEN 'early' ELSE 'late' END AS split FROM sess GROUP BY 1", _sess_sql()),
    "a50_a51_collected": _w("SELECT session_id, CAST(count(*) AS INTEGER) AS steps, string_agg(label_name, ' ' ORDER BY step_index) AS session_text FROM sess GROUP BY 1", _sess_sql()),
    "a52_behaviour": _w("SELECT session_id, steps, mean_score, fraction_above FROM srows", SROWS),
    "a53_verdict": _w("SELECT session_id, fires_content, fires_behavior, fires_content OR fires_behavior AS is_attack, CASE WHEN fires_content THEN top_label WHEN fires_behavior THEN 'anomalous_session' ELSE 'benign' END AS predicted_label FROM ver", VERDICT),
    "a54_calibrate": _w(f"SELECT round(pq, 6) AS per_query, {_youden_sql('m')} AS mean, {_youden_sql('f')} AS fraction, {_youden_sql('attack_prob')} AS content FROM lim", SROWS + ", lim AS (SELECT quantile_cont(sess.score, 0.9) AS pq FROM sess JOIN srows USING (session_id) WHERE srows.label = 0), cal AS (SELECT session_id, srows.label, attack_prob, round(avg(score), 6) AS m, round(avg(CAST(score > pq AS DOUBLE)), 6) AS f FROM sess JOIN srows USING (session_id), lim GROUP BY ALL)"),
    "g1_decide": _w(f"SELECT id, {_G1} AS action FROM dd", DECIDE),
    "g2_worst_step": _w("SELECT session_id, step_index, q AS is_sqli, id FROM (SELECT *, predicted <> 'normal' AS q, row_number() OVER (PARTITION BY session_id ORDER BY predicted = 'normal', step_index) AS k FROM sess) WHERE k = 1", _sess_sql()),
    "q7_hold_outcome": _w("SELECT id, CASE WHEN id % 4 = 0 THEN 'approved' WHEN epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) > 300000000 THEN 'deny' ELSE 'held' END AS outcome FROM scored"),
    "q1_enqueue": _w("SELECT DISTINCT id FROM items WHERE id % 3 = 0 AND id % 2 = 1", ITEMS),
    "q2_decided": _w("SELECT id, status, final_label FROM dec", DECIDED),
    "q2_errors": _w("SELECT id, action, error FROM dj WHERE error IS NOT NULL", DECIDED),
    "q3_counts": _w("SELECT count(*) FILTER (status IS NULL) AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'rejected') AS rejected, round(count(*) FILTER (status = 'approved') / nullif(CAST(count(*) FILTER (status IN ('approved', 'corrected')) AS DOUBLE), 0), 6) AS acceptance_rate FROM items LEFT JOIN dec USING (id)", DECIDED),
    "q4_confirmed": _w(f"SELECT id, final_label AS label, {ID.format('final_label')} AS label_id, status = 'corrected' AS was_corrected FROM dec WHERE status <> 'rejected'", DECIDED),
    "q5_without_round": _w("SELECT id FROM items WHERE round_id <> 'r1'", ITEMS),
    "q6_harvest": _w("SELECT id, predicted AS ai_label, label_name AS label, predicted <> label_name AS was_corrected FROM scored WHERE predicted <> 'normal' OR confidence < 0.6"),
    "l1_page": _w("SELECT id FROM items LEFT JOIN dec USING (id) WHERE status IS NULL ORDER BY created_at, id LIMIT 20 OFFSET 10", DECIDED),
    "l3_newest": _w("SELECT id FROM items ORDER BY created_at DESC, id LIMIT 25", ITEMS),
    "w6_first_reaching": _w("SELECT min(position) AS position FROM (SELECT position, sum(CAST(label = 5 AS INT)) OVER (ORDER BY position) AS c, label FROM scored) WHERE c = 20 AND label = 5"),
    "w11_latest_version": "SELECT version, content_hash FROM (SELECT (n_regionkey + 1) || '.' || n_nationkey AS version, md5(n_name) AS content_hash, n_regionkey, n_nationkey FROM nation) ORDER BY n_regionkey DESC, n_nationkey DESC LIMIT 1",
    "g3_gate": _w("SELECT CAST(model AS INTEGER) AS model, CASE WHEN skip THEN 'direct_promote' WHEN f1_ok AND fpr_ok AND lost IS NULL AND weak IS NULL THEN 'promote' ELSE 'reject' END AS verdict, CASE WHEN none THEN 'no_champion' WHEN other THEN 'cross_major_refused' ELSE 'same_major' END AS comparison, CASE WHEN NOT skip THEN coalesce(lost, '') END AS regressions, CASE WHEN NOT skip THEN coalesce(weak, '') END AS weak_new, CASE WHEN NOT skip THEN f1_ok END AS f1_ok, CASE WHEN NOT skip THEN fpr_ok END AS fpr_ok FROM gg", GATE),
    "g4_quality_floor": _w("SELECT CAST(model AS INTEGER) AS model, f = '' AS passed, f AS failing FROM (SELECT model, concat_ws(',', CASE WHEN f1 < 0.84 THEN 'f1_macro' END, CASE WHEN fpr > 0.15 THEN 'fpr' END, CASE WHEN (SELECT count(*) FROM er WHERE er.model = eb.model AND r < 0.8) > 0 THEN 'recall' END) AS f FROM eb)", EVAL),
    "g5_shadow_gate": _w("SELECT CAST(sum(n) AS BIGINT) AS n_rows, sum(n) FILTER (truth = 'normal' AND predicted <> 'normal') / CAST(sum(n) FILTER (truth = 'normal') AS DOUBLE) <= 0.145 AND (SELECT avg(f1) FROM f WHERE support > 0) >= 0.88 AS passed FROM cells", REPORT.replace("FROM scored GROUP BY ALL", "FROM scored WHERE position < 500 GROUP BY ALL", 1)),
    "g6_content_hash": _w("SELECT count(*) AS n, sha256(concat_ws(':', count(*), " + ", ".join(f"sum(CAST(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT))" for i in range(4)) + ")) AS content_hash FROM (SELECT sha256(id || chr(31) || label) AS h FROM scored)"),
    "g8_seal": f"WITH {_V}, c AS (SELECT s_suppkey, (s_nationkey % 6 + 1) || '.' || s_nationkey AS parent, md5(CAST(s_suppkey AS VARCHAR)) AS content_hash, s_suppkey % 3 = 0 AS fresh FROM supplier), j AS (SELECT c.*, version IS NOT NULL AS known FROM c LEFT JOIN ver ON version = parent) SELECT parent, content_hash, CASE WHEN fresh OR NOT known THEN 'major' ELSE 'minor' END AS bump, CASE WHEN known THEN CASE WHEN fresh THEN (CAST(split_part(parent, '.', 1) AS INT) + 1) || '.0' ELSE split_part(parent, '.', 1) || '.' || (CAST(split_part(parent, '.', 2) AS INT) + 1) END END AS version, CASE WHEN known THEN CASE WHEN fresh THEN 'stacked' ELSE '' END ELSE CASE WHEN fresh THEN 'normal,stacked' ELSE 'normal' END END AS new_classes, CASE WHEN NOT known THEN 'unknown parent' END AS error FROM j",
    "g9_stages": FOLDED + """SELECT branch, CASE WHEN z.live AND z.f = v THEN 'production' ELSE 'archived' END AS stage, count(*) AS n FROM (SELECT DISTINCT branch, v FROM e WHERE a = 'promote') JOIN r USING (branch) GROUP BY ALL""",
    "g9_resolve_active": FOLDED + "SELECT branch, CASE WHEN z.live THEN z.f ELSE 'base' END AS version FROM r",
    "g10_training_set": _w(", u AS (SELECT id, 't' || (id % 97) AS query_canonical, label, NULL::TIMESTAMP AS c, 0 AS r FROM scored WHERE id % 2 = 0 UNION ALL SELECT id, 't' || (id % 89), label, ts, 1 FROM scored WHERE id % 2 = 1 AND label > 0) SELECT id, query_canonical, label FROM (SELECT *, row_number() OVER (PARTITION BY query_canonical ORDER BY r DESC, c DESC NULLS LAST, id DESC) AS k FROM u) WHERE k = 1"),
    "u2_golden": _w("SELECT id FROM scored WHERE id % 4 = 0 OR id % 6 = 0"),
    "u4_new_classes": f"WITH {_V} SELECT version, 'union_based' AS new_classes FROM ver",
}
