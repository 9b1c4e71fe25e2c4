"""Search over sets of features: one detector for each set, fitted, scored and measured together.

All sets share a scan: a pass over the training rows sums the subgradients of every set's one-class
SVM in the tasks, a pass over the tested rows scores all of them, and the curves of all sets are
summed over ranges of set and score. The number of jobs doesn't grow with that of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficwarden.operators.models import fit_scaling, scaled
from trafficwarden.operators.order import kept, quantiles, running_sums, spread

BASE = ["length", "special_char_ratio", "sql_keyword_count", "entropy"]
CANDIDATES = ["quote_imbalance", "bigram_entropy", "same_type_run_ratio", "max_token_length"]
LOGGED = ["length", "max_token_length"]


def feature_sets(base: list[str] = BASE, candidates: list[str] = CANDIDATES) -> dict[str, list[str]]:
    """Name -> features: the base, the base with each and with all candidates, and every subset of the base with each candidate."""
    name = f"baseline_{len(base)}"
    out = {name: list(base), **{f"{name}+{c}": [*base, c] for c in candidates}, f"{name}+all_new": [*base, *candidates]}
    for c in candidates:
        for r in range(len(base) + 1):
            for some in combinations(base, r):
                out[f"subset[{','.join(some)}]+{c}"] = [*some, c]
    return out


def _cells(long: DataFrame, by: str, score: str, positive: Column, rows: str | None = None) -> DataFrame:
    """_g, _s, and how many rows of the group and score are positive (_pos) and not (_neg); a row of long counts as often as the column rows says."""
    n = F.col(rows) if rows else F.lit(1)
    some = long.select(F.col(by).alias("_g"), F.col(score).cast("double").alias("_s"), positive.alias("_p"), n.cast("long").alias("_n")).filter("_s is not null and _g is not null")
    count = lambda c, out: F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(out)
    return some.groupBy("_g", "_s").agg(count(F.col("_p"), "_pos"), count(~F.col("_p"), "_neg"))


def curves(long: DataFrame, by: str, score: str, positive: Column) -> DataFrame:
    """by, auc (ties count half), ks, p, n of every group; rows of a null score or group are left out, measures of a group without both kinds are null.

    Cells of equal scores are counted first; groups stand one after the other in a global order, so neither a group nor a score meets in one task.
    """
    return _curves(_cells(long, by, score, positive), by)


def _curves(cells: DataFrame, by: str) -> DataFrame:
    cells = kept(running_sums(cells, ["_g", "_s"], {"_cp": F.col("_pos"), "_cn": F.col("_neg")}))
    # what the groups in front add up to; a row for each group
    ends = cells.groupBy("_g").agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"), F.max("_cp").alias("_ep"), F.max("_cn").alias("_en"))
    rows = cells.join(ends, "_g")
    below, share = F.col("_cn") - (F.col("_en") - F.col("n")), lambda c, e, t: (F.col(c) - (F.col(e) - F.col(t))) / F.nullif(F.col(t).cast("double"), F.lit(0.0))
    out = rows.groupBy("_g").agg(
        F.max("p").alias("p"), F.max("n").alias("n"), F.sum(F.col("_pos") * (below - F.col("_neg") / 2.0)).alias("_area"),
        F.max(F.abs(share("_cp", "_ep", "p") - share("_cn", "_en", "n"))).alias("_gap"),
    )
    auc = F.col("_area") / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))
    return out.select(F.col("_g").alias(by), F.round(auc, 6).alias("auc"), F.round("_gap", 6).alias("ks"), "p", "n")


def matched(long: DataFrame, by: str, score: str, positive: Column, quantile: float = 0.95, rows: str | None = None) -> DataFrame:
    """by, threshold (the quantile of the benign scores), fpr and detection_rate strictly above it, auc, ks of every group.

    long is read once: all is found from its counts by group and score. With ``rows`` each of its rows counts as often as that column says.
    """
    cells = kept(_cells(long, by, score, positive, rows))
    limits = quantiles(cells.filter("_neg > 0"), ["_g"], "_s", [quantile], rows="_neg").select("_g", F.col("q")[0].alias("_t"))
    over = cells.join(F.broadcast(limits), "_g")  # a row for each group
    rate = lambda n: F.round(F.sum(F.when(F.col("_s") > F.col("_t"), F.col(n)).otherwise(0)) / F.nullif(F.sum(n).cast("double"), F.lit(0.0)), 6)
    rates = over.groupBy(F.col("_g").alias(by)).agg(F.round(F.max("_t"), 6).alias("threshold"), rate("_neg").alias("fpr"), rate("_pos").alias("detection_rate"))
    return rates.join(_curves(cells, by).select(by, "auc", "ks"), by)


def univariate(df: DataFrame, features: list[str], positive: Column) -> DataFrame:
    """feature, ks of benign against anomalous rows, all features in one pass; 0 where one of the kinds is missing."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(positive.alias("_positive"), F.explode(pairs).alias("_v")).select("_positive", "_v.*")
    return curves(long, "feature", "value", F.col("_positive")).select("feature", F.coalesce("ks", F.lit(0.0)).alias("ks"))


def _expanded(x: np.ndarray, turns: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """rows x dimensions to sets x rows x Fourier features."""
    return np.sqrt(2 / len(shift)) * np.cos(np.einsum("nd,sdf->snf", x, turns, optimize=True) + shift)


def fit_svms(train: DataFrame, masks: np.ndarray, nu: float = 0.05, gamma: float = 0.5, features: int = 64, iterations: int = 15, x: str = "x", seed: int = 0, rows: str | None = None) -> dict:
    """A one-class SVM over random Fourier features for each row of masks (which dimensions of x it sees). With ``rows`` each row counts as often as that column says."""
    rng = np.random.default_rng(seed)
    sets, dims = masks.shape
    turns = (rng.standard_normal((dims, features)) * np.sqrt(2 * gamma))[None] * masks[:, :, None]
    shift = rng.uniform(0, 2 * np.pi, features)
    vectors = train.select(x, (F.col(rows) if rows else F.lit(1)).cast("double").alias("_rows"))

    def sums(w: np.ndarray, rho: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, inside, n = np.zeros((sets, features)), np.zeros(sets), 0.0
            for part in parts:
                for at in range(0, len(part), 512):
                    z, times = _expanded(np.stack(part[x].to_numpy()[at : at + 512]), turns, shift), part["_rows"].to_numpy()[at : at + 512]
                    low = (np.einsum("snf,sf->sn", z, w) < rho[:, None]) * times
                    total += np.einsum("snf,sn->sf", z, low)
                    inside, n = inside + low.sum(1), n + times.sum()
            yield pd.DataFrame({"no": np.arange(sets), "g": total.tolist(), "low": inside.astype(np.int64), "n": int(n)})

        each = vectors.mapInPandas(run, "no int, g array<double>, low long, n long")
        added = each.groupBy("no").agg(F.sum("low").alias("low"), F.sum("n").alias("n"), *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(features)])
        got = sorted(added.collect())  # a row for each set
        if not got:
            return np.zeros((sets, features)), np.zeros(sets), 1
        return np.array([r[3:] for r in got], float), np.array([r.low for r in got], float), max(got[0].n, 1)

    g, _, n = sums(np.zeros((sets, features)), np.ones(sets))
    w = g / n
    rho = (w * w).sum(1)
    for step in range(1, iterations + 1):
        g, low, _ = sums(w, rho)
        rate = 1.0 / (step + 5)
        w, rho = w - rate * (w - g / (nu * n)), rho - rate * rho * (low / (nu * n) - 1) * 0.5
    return {"turns": turns, "shift": shift, "w": w, "rho": rho}


def svms_scores(df: DataFrame, model: dict, x: str = "x", out: str = "scores") -> DataFrame:
    """df with an array of the scores of all sets: above 0 outside the learned region."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # sets x features numbers

    @F.pandas_udf("array<double>")
    def score(xs: pd.Series) -> pd.Series:
        m, found = shared.value, []
        for at in range(0, len(xs), 512):
            z = _expanded(np.stack(xs.to_numpy()[at : at + 512]), m["turns"], m["shift"])
            found += (m["rho"] - np.einsum("snf,sf->ns", z, m["w"])).round(6).tolist()
        return pd.Series(found, dtype=object)

    return df.withColumn(out, score(F.col(x)))


def explore(train: DataFrame, tested: DataFrame, positive: Column, sets: dict[str, list[str]] | None = None, logged: list[str] | None = None) -> DataFrame:
    """name, features, threshold, fpr, detection_rate, auc, ks for every set of features.

    Each detector learns from the (benign) training rows; its threshold is the 95th percentile of the
    benign tested scores. Equal vectors are fitted and scored once, as one row of their number. Both tables
    have all features as columns, without nulls. An empty training table gives detectors that know
    nothing, an empty tested one no rows.
    """
    sets = feature_sets() if sets is None else sets
    names = list(dict.fromkeys(f for of in sets.values() for f in of))
    scaling = fit_scaling(train, names, [f for f in (LOGGED if logged is None else logged) if f in names])
    masks = np.array([[float(f in of) for f in names] for of in sets.values()])
    count = F.count("*").alias("rows")
    model = fit_svms(kept(spread(scaled(train, scaling).groupBy("x").agg(count))), masks, rows="rows")
    # kept: scores of a grouping column would be found before the rows are grouped
    vectors = kept(spread(scaled(tested, scaling).groupBy("x", positive.alias("positive")).agg(count)))
    long = svms_scores(vectors, model).select("positive", "rows", F.posexplode("scores").alias("no", "score"))
    given = tested.sparkSession.createDataFrame([(i, n, of) for i, (n, of) in enumerate(sets.items())], "no int, name string, features array<string>")
    return matched(long, "no", "score", F.col("positive"), rows="rows").join(F.broadcast(given), "no").select("name", "features", "threshold", "fpr", "detection_rate", "auc", "ks")
