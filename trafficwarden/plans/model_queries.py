"""Queries of classifiers and detectors, over derived traffic and numeric tables."""

from functools import reduce

from pyspark.sql import functions as F

from trafficwarden.functions import features as X
from trafficwarden.operators import curate as C
from trafficwarden.operators import explore as P
from trafficwarden.operators import metrics as E
from trafficwarden.operators import models as M
from trafficwarden.operators.order import kept, spread
from trafficwarden.plans.text_queries import BIGRAMS, ENTROPY, PLAIN, _c, tagged
from trafficwarden.plans.traffic import SCORED_SQL, scored

FEATURES = ["length", "special_char_ratio", "entropy", "quote_imbalance"]
DETECTORS = ["local_outlier_factor", "isolation_forest", "one_class_svm"]


def _positive():
    return F.col("is_attack")



def _corpus(s, d):
    """Traffic with labels and a split, each written once: the split counts and ranks the rows, fits and scores read them several times."""
    return kept(C.stratified_split(kept(tagged(s, d)), "label_name", "id", 0.25))


def _classified(s, d):
    rows = _corpus(s, d)
    model = M.fit_classifier(rows.filter("split = 'train'"))
    return M.classify(model, rows.filter("split = 'test'"))


def _compared(s, d):
    rows = _corpus(s, d)
    return M.compare_classifiers(rows.filter("split = 'train'"), rows.filter("split = 'test'"))


def _vectors(s, d, corpus=None):
    """Benign training rows and mixed queries as scaled vectors; equal vectors are one training row."""
    rows = kept(X.with_features(_corpus(s, d) if corpus is None else corpus, names=FEATURES).select("id", "is_attack", "split", *FEATURES))
    train = rows.filter("not is_attack and split = 'train'")
    scaling = M.fit_scaling(train, FEATURES, ["length"])
    # kept: fits pass over the one many times, each fit is measured on the other
    first = C.keep_first(M.scaled(train, scaling).select("id", "x"), ["x"], ["id"])
    return kept(spread(first)), kept(spread(M.scaled(rows.filter("split = 'test'"), scaling).select("id", "is_attack", "x")))


def _detector(name, **options):
    def run(s, d, corpus=None):
        train, queries = _vectors(s, d, corpus)
        scored = M.detector_scores(name, train, queries, **options)
        return scored.select("id", "is_attack", "anomaly_score")

    return run


def _parts(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_retailprice") / 50).cast("double")).alias("x"))


def _lof_parts(s, d):
    near = kept(M.nearest_rows(_parts(s, d), _parts(s, d), 5))
    return M.lof_scores(near, M.lof_tables(near)).select("id", F.round("lof", 4).alias("lof"))


def _scaled_lineitem(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return M.scaled(rows, M.fit_scaling(rows.filter("q > 10"), ["q", "p"], ["p"])).select("l_orderkey", "l_linenumber", F.round(F.col("x")[0], 6).alias("q"), F.round(F.col("x")[1], 6).alias("p"))


SEARCHED = [*P.BASE, *P.CANDIDATES]


def _subsets(s, d):
    """All 70 sets of features: fitted on benign training rows, measured on benign tested rows and all attacks."""
    rows = kept(X.with_features(_corpus(s, d), names=SEARCHED))
    return P.explore(rows.filter("not is_attack and split = 'train'"), rows.filter("is_attack or split = 'test'"), _positive())


def _given_scores(s, d):
    """The measures of the 70 sets, with the sum of a set's features (lengths in hundreds) as score."""
    rows = X.with_features(tagged(s, d), names=SEARCHED).groupBy("is_attack", *SEARCHED).agg(F.count("*").alias("rows"))
    value = lambda f: F.col(f) / 100.0 if f in P.LOGGED else F.col(f)
    pairs = [F.struct(F.lit(n).alias("name"), F.round(reduce(lambda a, b: a + b, map(value, of)), 6).alias("score")) for n, of in P.feature_sets().items()]
    long = spread(rows).select("is_attack", "rows", F.explode(F.array(*pairs)).alias("v")).select("is_attack", "rows", "v.*")
    return P.matched(long, "name", "score", _positive(), rows="rows")


def _zero_day(s, d):
    rows = _corpus(s, d)
    return M.zero_day_runs(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "label", [1, 2, 3, 4, 5], _detector("isolation_forest")(s, d, rows), threshold=0.55)


def _tested(s, d):
    """Rows with features, parted in training and tested ones."""
    rows = kept(X.with_features(_corpus(s, d), names=FEATURES).withColumn("length", F.col("length").cast("double")))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _importance(s, d):
    train, tested = _tested(s, d)
    return M.detector_importance(train.filter("not is_attack"), tested, FEATURES, _positive(), ["length"])


def _impact(s, d):
    """A benign pool into which the attacks of one class have leaked, and the pool without them."""
    train, tested = _tested(s, d)
    pool = train.filter("not is_attack or label_name = 'stacked'")
    return M.pool_impact(pool, _positive(), tested, FEATURES, _positive(), logged=["length"], threshold=0.55)


def _latency(s, d):
    """Milliseconds a row of the fitted classifier over the tested rows, in batches."""
    rows = _corpus(s, d)
    model, tested = M.fit_classifier(rows.filter("split = 'train'")), rows.filter("split = 'test'")
    return E.latency(kept(E.scoring_times(lambda df: M.classify(model, df).select("id", "predicted", "confidence"), tested, "id")), "seconds", "rows")


QUERIES = {
    "ml1_gram_frequencies": lambda s, d: M.gram_frequencies(tagged(s, d)),
    "ml2_ml3_classify": lambda s, d: _classified(s, d).select("id", "label_name", "predicted", "confidence", "attack_prob", "is_sqli"),
    "ml4_compare_classifiers": _compared,
    "ml5_scaling": _scaled_lineitem,
    "ml6_lof_parts": _lof_parts,
    "ml6_lof": _detector("local_outlier_factor"),
    "ml7_isolation_forest": _detector("isolation_forest"),
    "ml8_one_class_svm": _detector("one_class_svm"),
    "ml9_flags": lambda s, d: M.flags(_detector("isolation_forest")(s, d), 0.55),
    "ml10_grid_search": lambda s, d: M.grid_search("isolation_forest", *_vectors(s, d), _positive(), {"trees": [10, 30], "sample": [64, 256]}),
    "ml11_compare_detectors": lambda s, d: M.compare_detectors(*_vectors(s, d), _positive(), DETECTORS),
    "l4_best": lambda s, d: M.best(M.grid_search("isolation_forest", *_vectors(s, d), _positive(), {"trees": [10, 30]}), "options", "auc"),
    "ml12_zero_day": _zero_day,
    "ml13_univariate_ks": lambda s, d: P.univariate(X.with_features(tagged(s, d), names=SEARCHED), SEARCHED, _positive()),
    "ml13_subsets": _subsets,
    "ml13_given_scores": _given_scores,
    "a35_scoring_latency": _latency,
    "a36_permutation": _importance,
    "a36_given_scores": lambda s, d: E.permutation_importance(X.with_features(tagged(s, d), names=FEATURES).withColumn("length", F.col("length").cast("double")), ["special_char_ratio", "quote_imbalance"], "id", lambda df: df.withColumn("score", F.round(F.col("special_char_ratio") + F.col("quote_imbalance") / 4, 6)), _positive()),
    "a37_impact": _impact,
    "a37_given_scores": lambda s, d: M.impact(scored(s, d).select("id", "is_attack", F.round(F.col("score") - 0.9, 6).alias("anomaly_score")), scored(s, d).select("id", "is_attack", F.round(F.col("score") * 0.9 + F.col("confidence") * 0.1 - 0.9, 6).alias("anomaly_score")), _positive()),
    "m16_fragment_sessions": lambda s, d: C.fragment_sessions(tagged(s, d).filter("is_attack"), "query_raw", "id"),
}

_VALUES = "WITH " + _c("").removeprefix("WITH ") + ", q AS (SELECT id, is_attack, query_canonical AS t FROM canon), " + ENTROPY + ", " + BIGRAMS + f""",
v AS (SELECT q.id, q.is_attack, {', '.join(f"CAST({PLAIN[f]} AS DOUBLE) AS {f}" for f in SEARCHED if f in PLAIN)}, coalesce(round(en.v, 6), 0.0) AS entropy, coalesce(round(be.v, 6), 0.0) AS bigram_entropy FROM q LEFT JOIN en USING (id) LEFT JOIN be USING (id))"""
_SETS = "[" + ", ".join("{'n': '" + n + "', 's': round(" + " + ".join(f"{f} / 100.0::DOUBLE" if f in P.LOGGED else f for f in of) + ", 6)}" for n, of in P.feature_sets().items()) + "]"
_CELLS = """, c AS (SELECT g, x, CAST(count(*) FILTER (is_attack) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT is_attack) AS DOUBLE) AS n FROM l GROUP BY g, x),
w AS (SELECT *, sum(p) OVER o AS cp, sum(n) OVER o AS cn, sum(p) OVER (PARTITION BY g) AS tp, sum(n) OVER (PARTITION BY g) AS tn FROM c WINDOW o AS (PARTITION BY g ORDER BY x)),
m AS (SELECT g, round(sum(p * (cn - n / 2)) / any_value(tp * tn), 6) AS auc, round(max(abs(cp / tp - cn / tn)), 6) AS ks FROM w GROUP BY g)"""


def _shuffled_sql():
    """AUC that is lost when one of two columns is shuffled by ranks of SHA-256."""
    rank = lambda seed: f"row_number() OVER (ORDER BY substr(sha256('{seed}:' || id), 1, 16), id)"
    columns = ["special_char_ratio", "quote_imbalance"]
    tables = [f"r{i} AS (SELECT a.id, a.is_attack, b.y AS {c}, a.{columns[1 - i]} FROM (SELECT *, {rank(f'{i}:rows')} AS k FROM v) a JOIN (SELECT {c} AS y, {rank(f'{i}:values')} AS k FROM v) b USING (k))" for i, c in enumerate(columns)]
    long = " UNION ALL ".join(f"SELECT '{g}' AS g, is_attack, round(special_char_ratio + quote_imbalance / 4, 6) AS x FROM {t}" for g, t in (("", "v"), (columns[0], "r0"), (columns[1], "r1")))
    return _VALUES + ", " + ", ".join(tables) + f", l AS ({long})" + _CELLS + " SELECT g AS feature, round((SELECT auc FROM m WHERE g = '') - auc, 6) AS \"drop\" FROM m WHERE g <> ''"


_IMPACT = "round(avg(CAST(x > 0 AS DOUBLE)) FILTER (NOT is_attack), 6) AS fpr, round(avg(CAST(x > 0 AS DOUBLE)) FILTER (is_attack), 6) AS detection_rate, " + ", ".join(f"round(quantile_cont(x, {p}) FILTER (NOT is_attack), 6) AS {n}" for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + ", round(max(x) FILTER (NOT is_attack), 6) AS largest, round(avg(x) FILTER (NOT is_attack), 6) AS mean"
_MEASURES = ["fpr", "detection_rate", "p50", "p90", "p99", "largest", "mean"]

SQL = {
    "a36_given_scores": _shuffled_sql(),
    "a37_given_scores": f"WITH {SCORED_SQL}, l AS (SELECT 'current' AS pool, is_attack, round(score - 0.9::DOUBLE, 6) AS x FROM scored UNION ALL SELECT 'cleaned', is_attack, round(score * 0.9::DOUBLE + confidence * 0.1::DOUBLE - 0.9::DOUBLE, 6) FROM scored), p AS (SELECT pool, {_IMPACT} FROM l GROUP BY pool) SELECT * FROM p UNION ALL SELECT 'difference', " + ", ".join(f"round(a.{m} - b.{m}, 6)" for m in _MEASURES) + " FROM p a, p b WHERE a.pool = 'cleaned' AND b.pool = 'current'",
    "ml1_gram_frequencies": _c(r", w AS (SELECT id, ' ' || unnest(regexp_extract_all(query_canonical, '\S+')) || ' ' AS t FROM canon), g AS (SELECT id, substr(t, i, n) AS gram FROM w, range(2, 5) a(n), range(1, 400) b(i) WHERE n <= length(t) AND i <= length(t) - n + 1) SELECT gram, count(DISTINCT id) AS df, count(*) AS tf, round(ln(((SELECT count(*) FROM canon) + 1) / CAST(count(DISTINCT id) + 1 AS DOUBLE)) + 1, 6) AS idf FROM g GROUP BY gram"),
    "ml5_scaling": "WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, ln(1 + CAST(l_extendedprice AS DOUBLE)) AS p FROM lineitem), f AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp FROM r WHERE q > 10) SELECT l_orderkey, l_linenumber, round((q - mq) / sq, 6) AS q, round((p - mp) / sp, 6) AS p FROM r, f",
    "ml6_lof_parts": """WITH v AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) / 50 AS b FROM part),
near AS (SELECT id, nb, d FROM (SELECT x.id, y.id AS nb, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d, row_number() OVER (PARTITION BY x.id ORDER BY d, y.id) AS k FROM v x, v y WHERE x.id <> y.id) WHERE k <= 5),
kd AS (SELECT id, max(d) AS kdist FROM near GROUP BY id), lr AS (SELECT near.id, 1.0 / (avg(greatest(d, kdist)) + 1e-10::DOUBLE) AS lrd FROM near JOIN kd ON kd.id = nb GROUP BY 1)
SELECT near.id, round(avg(o.lrd) / any_value(s.lrd), 4) AS lof FROM near JOIN lr o ON o.id = nb JOIN lr s ON s.id = near.id GROUP BY near.id""",
    "ml13_univariate_ks": _VALUES + ", l AS (SELECT is_attack, u.n AS g, u.s AS x FROM (SELECT is_attack, unnest([" + ", ".join(f"{{'n': '{f}', 's': {f}}}" for f in SEARCHED) + "]) AS u FROM v))" + _CELLS + " SELECT g AS feature, ks FROM m",
    "ml13_given_scores": _VALUES + f", l AS (SELECT is_attack, u.n AS g, u.s AS x FROM (SELECT is_attack, unnest({_SETS}) AS u FROM v))" + _CELLS + """, th AS (SELECT g, quantile_cont(x, 0.95) FILTER (NOT is_attack) AS t FROM l GROUP BY g),
r AS (SELECT g, round(any_value(t), 6) AS threshold, round(avg(CAST(x > t AS DOUBLE)) FILTER (NOT is_attack), 6) AS fpr, round(avg(CAST(x > t AS DOUBLE)) FILTER (is_attack), 6) AS detection_rate FROM l JOIN th USING (g) GROUP BY g)
SELECT g AS name, threshold, fpr, detection_rate, auc, ks FROM r JOIN m USING (g)""",
}
