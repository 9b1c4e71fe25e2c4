"""Classifiers and anomaly detectors as distributed jobs.

Classifier: TF-IDF of character n-grams within words, and multinomial logistic regression. Detectors:
local outlier factor, isolation forest, and a one-class SVM over random Fourier features. Neighbours
are searched in cells of space; trees grow one per group.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from trafficwarden.functions.text import LABELS, word_ngrams
from trafficwarden.operators import grams
from trafficwarden.operators.metrics import auc, class_report, confusion, detector_report, latency, permutation_importance, summary
from trafficwarden.operators.neighbours import CELL_ROWS, NeighbourSearch
from trafficwarden.operators.order import kept, quantiles, shared_folder, spread

# Classifier.

VOCABULARY = 50_000
#: Different training rows of a part, at most, and characters of their texts: their n-grams take some 35 bytes for each.
PART_ROWS, PART_CHARS = 50_000, 4_000_000
#: Different training rows of fits that run at the same time, together about: they keep their n-grams, some 1 KB a row.
BESIDE_ROWS = 1_000_000
#: Parts whose sums are added up in one step.
FEW_PARTS = 4


def with_grams(df: DataFrame, text: str = "query_canonical", low: int = 2, high: int = 4) -> DataFrame:
    return df.withColumn("grams", word_ngrams(F.coalesce(F.col(text), F.lit("")), low, high))


def gram_frequencies(df: DataFrame, text: str = "query_canonical") -> DataFrame:
    """gram, df (rows that hold it), tf (all places), idf (ln((n + 1) / (df + 1)) + 1)."""
    n = df.agg(F.count("*").alias("n"))  # one row
    return _gram_counts(df, text).join(F.broadcast(n)).select("gram", "df", "tf", F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def _gram_counts(df: DataFrame, text: str, rows: str | None = None) -> DataFrame:
    """gram, df, tf in one pass over the different texts and their rows: counted in Arrow batches, added up by gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for found in grams.counted(texts, batch.column(1).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), *map(pa.array, found[1:])], ["gram", "df", "tf"])

    different = df.groupBy(F.col(text).cast("string").alias("t")).agg(F.sum(rows).alias("n") if rows else F.count("*").alias("n"))
    # small rows, much work on each: one part for each core, not one for so many bytes
    counted = different.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "gram string, df long, tf long")
    return counted.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def fit_tfidf(df: DataFrame, n: int, text: str = "query_canonical", vocabulary: int = VOCABULARY, rows: str | None = None) -> PipelineModel:
    """Counts of the most frequent grams (ties by gram), smooth IDF plus one, length one: out column tfidf of rows with the column grams. df stands for n rows, each of its own for as many as the column rows says."""
    kept = _gram_counts(df, text, rows=rows).orderBy(F.desc("tf"), "gram").limit(vocabulary).collect()  # vocabulary rows at most
    found = [r.gram for r in kept] or [""]
    counts = _counting(df.sparkSession, found)
    idf = np.log((n + 1) / (np.array([r.df for r in kept] or [0]) + 1)) + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="scaled")
    model = PipelineModel([counts, scale, Normalizer(inputCol="scaled", outputCol="tfidf", p=2.0)])
    weights = grams.GramWeights(found, idf)
    model._gram_weights = weights if weights.usable else None
    return model


def _counting(spark: SparkSession, vocabulary: list[str]) -> CountVectorizerModel:
    """A count of these grams, none of which holds a line feed; they are handed over in one call, not one each."""
    if vocabulary == [""]:
        return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="counts")
    split = spark._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(vocabulary))
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", split)
    model.setInputCol("grams").setOutputCol("counts")._set(vocabSize=len(vocabulary))
    return model


def _weights(model: PipelineModel) -> grams.GramWeights | None:
    """The n-grams and weights of a fitted TF-IDF, found once a model; null where the stages are others, or the vocabulary has too many characters."""
    if not hasattr(model, "_gram_weights"):
        kinds = [CountVectorizerModel, ElementwiseProduct, Normalizer]
        ours = len(model.stages) >= 3 and all(isinstance(s, k) for s, k in zip(model.stages, kinds))
        found = grams.GramWeights(model.stages[0].vocabulary, model.stages[1].getScalingVec().toArray()) if ours else None
        model._gram_weights = found if found and found.usable else None
    return model._gram_weights


def with_tfidf(model: PipelineModel, df: DataFrame, text: str = "query_canonical") -> DataFrame:
    """df with the column tfidf of a fitted TF-IDF: a sparse vector of length one, found in Arrow batches."""
    found = _weights(model)
    if found is None:
        return PipelineModel(model.stages[:3]).transform(with_grams(df, text)).drop("grams", "counts", "scaled")
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf(VectorUDT())
    def vectors(texts: pa.Array) -> pa.Array:
        parts = list(shared.value.rows(texts.to_pylist()))
        before = np.cumsum([0, *(len(at) for _, _, at, _ in parts)])
        ends = pa.array(np.concatenate([[0], *(e + b for (_, e, _, _), b in zip(parts, before))]).astype(np.int32))
        joined = [np.concatenate([p[i] for p in parts] or [np.empty(0, t)]) for i, t in ((2, np.int32), (3, np.float64))]
        n = len(texts)
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, shared.value.size, np.int32)), *(pa.ListArray.from_arrays(ends, pa.array(j)) for j in joined)], ["type", "size", "indices", "values"])

    return df.withColumn("tfidf", vectors(F.col(text).cast("string")))


def fit_classifier(df: DataFrame, text: str = "query_canonical", label: str = "label", vocabulary: int = VOCABULARY, iterations: int = 100, estimator=None) -> PipelineModel:
    """TF-IDF and a classifier; rows of df are text and a class id. The weight of the regularisation is 1 / n.

    Rows of one text and class are one row of their number as weight, which leaves the loss of a
    regression, of Bayes or of the perceptron as it is. Trees, which draw rows (boosted ones for their cuts), take each row by itself.
    """
    return fit_counted(counted_rows(df, text, label), text, vocabulary, iterations, estimator, df.withColumn("_y", F.col(label).cast("double")))


def counted_rows(df: DataFrame, text: str = "query_canonical", label: str = "label") -> DataFrame:
    """The text, _y (class id) and _rows of the different pairs of text and class, written once."""
    return kept(df.groupBy(F.col(text).cast("string").alias(text), F.col(label).cast("double").alias("_y")).agg(F.count("*").alias("_rows")))


def side_by_side(jobs: list[Callable], different: int) -> list:
    """What the jobs return, each of which fits on at most so many different rows: small fits run at the same time, as an iteration of one leaves cores idle, large ones in turn."""
    at_once = max(1, min(len(jobs), BESIDE_ROWS // max(different, 1)))
    if at_once == 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def fit_counted(different: DataFrame, text: str = "query_canonical", vocabulary: int = VOCABULARY, iterations: int = 100, estimator=None, each: DataFrame | None = None) -> PipelineModel:
    """``fit_classifier`` on ``counted_rows``, of several tables too; each has the rows one by one, for estimators that take them so."""
    size = different.agg(F.sum("_rows").alias("n"), F.count("*").alias("m"), F.sum(F.length(text)).alias("chars")).first()
    n = size.n or 0
    tfidf = fit_tfidf(different, n, text, vocabulary, "_rows")
    estimator = estimator or LogisticRegression(family="multinomial", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-4)
    estimator = estimator.copy().setParams(featuresCol="tfidf", labelCol="_y") if hasattr(estimator, "setParams") else estimator
    if isinstance(estimator, MultilayerPerceptronClassifier):
        estimator.setLayers([len(tfidf.stages[0].vocabulary), 64, len(LABELS)])
    if isinstance(estimator, (LogisticRegression, NaiveBayes, MultilayerPerceptronClassifier)):
        # small rows, much work on each: more parts than their bytes would give
        cores = different.sparkSession.sparkContext.defaultParallelism
        least = max(-(-size.m // PART_ROWS), -(-(size.chars or 0) // PART_CHARS))
        rows = different.repartition(max(cores, least)).withColumn("_weight", F.col("_rows").cast("double"))
        if isinstance(estimator, MultilayerPerceptronClassifier) and tfidf._gram_weights:
            from trafficwarden.operators import perceptron

            model = PipelineModel([*tfidf.stages, perceptron.fit(estimator, rows, text, tfidf._gram_weights, n)])
            model._gram_weights = tfidf._gram_weights
            return model
        estimator.setWeightCol("_weight")
        if least <= FEW_PARTS:
            # few rows: an iteration takes less time than the sums of many parts, so the n-grams are found on all cores and kept in few
            ready = kept(with_tfidf(tfidf, rows, text).select("_y", "_weight", "tfidf"))
            ready = ready.coalesce(max(least, min(FEW_PARTS, cores)))
        else:
            ready = with_tfidf(tfidf, rows, text).select("_y", "_weight", "tfidf")
    else:
        ready = with_tfidf(tfidf, each, text)
    model = PipelineModel([*tfidf.stages, estimator.fit(ready)])
    model._gram_weights = tfidf._gram_weights
    return model


def _regression(model: PipelineModel) -> tuple | None:
    """(weights, coefficients by n-gram and class, intercepts) of a model that is a TF-IDF and a regression over several classes; null for others, found once a model."""
    if not hasattr(model, "_linear"):
        model._linear, last = None, model.stages[-1]
        if len(model.stages) == 4 and isinstance(last, LogisticRegressionModel) and last.getFamily() == "multinomial" and not last.isSet("thresholds") and _weights(model):
            c, i = np.ascontiguousarray(last.coefficientMatrix.toArray().T), last.interceptVector.toArray()
            if np.isfinite(c).all() and np.isfinite(i).all():
                model._linear = (_weights(model), c, i)
    return model._linear


def _regressed(df: DataFrame, text: str, weights: grams.GramWeights, coefficients: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """df with probability (an array over the classes) and prediction of a regression on n-grams, found in Arrow batches without a vector a row."""
    shared = df.sparkSession.sparkContext.broadcast((weights, coefficients, intercepts))

    @F.arrow_udf("struct<probability: array<double>, prediction: double>")
    def score(texts: pa.Array) -> pa.Array:
        weights, coefficients, intercepts = shared.value
        raw = np.concatenate([np.empty((0, len(intercepts))), *grams.linear(weights.rows(texts.to_pylist()), coefficients, intercepts)])
        p = np.exp(raw - raw.max(1, keepdims=True, initial=-np.inf))
        p /= p.sum(1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * len(intercepts)), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(raw.argmax(1).astype(float))], ["probability", "prediction"])

    return df.withColumn("_scored", score(F.col(text).cast("string"))).withColumns({n: F.col(f"_scored.{n}") for n in ("probability", "prediction")}).drop("_scored")


def classify(model: PipelineModel, df: DataFrame, text: str = "query_canonical", least: float = 0.5) -> DataFrame:
    """df with probabilities (by class, 0 for unknown ones), predicted, confidence, attack_prob, is_sqli."""
    regression = _regression(model)
    if regression:
        out = _regressed(df, text, *regression)
    elif _weights(model):
        out = PipelineModel(model.stages[3:]).transform(with_tfidf(model, df, text))
    else:
        out = model.transform(with_grams(df, text))
    p = F.col("probability") if regression else vector_to_array(F.col("probability")) if "probability" in out.columns else F.transform(F.sequence(F.lit(0), F.lit(len(LABELS) - 1)), lambda i: (i == F.col("prediction").cast("int")).cast("double"))
    names = F.array(*[F.lit(x) for x in LABELS])
    probability = F.map_from_arrays(names, F.transform(F.sequence(F.lit(0), F.lit(len(LABELS) - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0))))
    extra = {"probabilities": probability, "predicted": F.get(names, F.col("prediction").cast("int")), "confidence": F.round(F.array_max(p), 6), "attack_prob": F.round(1 - F.coalesce(F.get(p, F.lit(0)), F.lit(0.0)), 6)}
    out = out.withColumns(extra)
    return out.select(*df.columns, *extra).withColumn("is_sqli", F.col("attack_prob") >= least)


#: N-grams of the candidates whose fits keep a dense histogram or layer of them.
DENSE = 2000


def candidates() -> dict:
    """Classifiers to compare; boosted trees stand for gradient boosting, one class against the rest. The network reads characters, the others n-grams."""
    from trafficwarden.operators.sequences import SequenceClassifier

    return {
        "logistic_regression": LogisticRegression(family="multinomial", maxIter=50),
        "naive_bayes": NaiveBayes(),
        "random_forest": RandomForestClassifier(numTrees=20, maxDepth=8, seed=1),
        "boosted_trees": OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=1)),
        "perceptron": MultilayerPerceptronClassifier(maxIter=50, seed=1),
        "character_network": SequenceClassifier(),
    }


COMPARED = "candidate string, f1_macro double, accuracy double, f1_by_class map<string,double>, confusion map<string,long>, train_seconds double, score_ms_per_row double, p50_ms double, p95_ms double, size_bytes long"


def compare_classifiers(train: DataFrame, test: DataFrame, text: str = "query_canonical", names: list[str] | None = None, done: set[str] | None = None, vocabulary: int = VOCABULARY, batches: int = 4, results: str | None = None) -> DataFrame:
    """candidate, f1_macro, accuracy, f1_by_class, confusion (truth>predicted -> rows), train_seconds, score_ms_per_row, p50_ms, p95_ms, size_bytes.

    Candidates in done are skipped. results is a folder of finished rows: a candidate found there isn't
    fitted again, a new one is added as soon as it is measured, so a lost run goes on where it was. All
    test rows are scored, in batches by the hash of the text; p50 and p95 are milliseconds a row over the
    batches. The size is that of the saved model. Trees and the perceptron take at most ``DENSE`` n-grams.
    """
    import time

    from trafficwarden.sources.readers import append_ledger, read_ledger

    spark = train.sparkSession
    finished = [tuple(r) for r in read_ledger(spark, results, COMPARED).collect()] if results else []  # a row a candidate
    finished, rows = {r[0]: r for r in finished}, []
    part = F.pmod(F.xxhash64(text), F.lit(batches))
    for name in names or list(candidates()):
        if name in (done or set()):
            continue
        if name in finished:
            rows.append(finished[name])
            continue
        began = time.time()
        estimator = candidates()[name]
        if name == "character_network":
            model = PipelineModel([estimator.fit(train, {estimator.text: text})])
        else:
            model = fit_classifier(train, text, vocabulary=vocabulary if name in ("logistic_regression", "naive_bayes") else min(vocabulary, DENSE), estimator=estimator)
        took, cells, timed = time.time() - began, Counter(), []
        for i in range(batches):
            began = time.time()
            found = confusion(classify(model, test.filter(part == i), text)).collect()  # a row for each pair of classes
            if found:
                timed.append((time.time() - began, sum(r.n for r in found)))
                cells.update({(r.truth, r.predicted): r.n for r in found})
        table = spark.createDataFrame([(*k, n) for k, n in cells.items()], "truth string, predicted string, n long")
        r, each = summary(table).first(), {x.label: x.f1 for x in class_report(table).collect()}
        q = latency(spark.createDataFrame(timed, "seconds double, rows long"), "seconds", "rows").first()
        per_row = sum(t for t, _ in timed) * 1000 / max(sum(n for _, n in timed), 1)
        rows.append((name, r.f1_macro, r.accuracy, each, {f"{t}>{p}": n for (t, p), n in cells.items()}, round(took, 3), round(per_row, 4), q.p50_ms, q.p95_ms, saved_size(model)))
        if results:
            append_ledger(spark.createDataFrame(rows[-1:], COMPARED), results)
    return spark.createDataFrame(rows, COMPARED)


def saved_size(model: PipelineModel) -> int:
    """Bytes of the files of the saved model."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0]


# Preprocessing of features for detectors.


def fit_scaling(train: DataFrame, features: list[str], logged: list[str] | None = None) -> dict[str, tuple[bool, float, float]]:
    """feature -> (log1p first, mean, population standard deviation), from the training rows alone."""
    logged = logged or []
    value = lambda f: F.log1p(f) if f in logged else F.col(f).cast("double")
    r = train.agg(*[F.mean(value(f)).alias(f"m_{f}") for f in features], *[F.stddev_pop(value(f)).alias(f"s_{f}") for f in features]).first()
    return {f: (f in logged, float(r[f"m_{f}"] or 0.0), float(r[f"s_{f}"] or 0.0) or 1.0) for f in features}


def scaled(df: DataFrame, scaling: dict[str, tuple[bool, float, float]], out: str = "x") -> DataFrame:
    """df with an array of scaled features."""
    return df.withColumn(out, F.array(*[((F.log1p(f) if log else F.col(f).cast("double")) - m) / s for f, (log, m, s) in scaling.items()]))


# Local outlier factor.


def nearest_rows(queries: DataFrame, train: DataFrame, k: int, key: str = "id", x: str = "x", rows: int = CELL_ROWS) -> DataFrame:
    """key, n (rank from 1), neighbour, distance: the k nearest training rows other than the row itself, ties by key. Exact; see ``NeighbourSearch``."""
    return NeighbourSearch(train, k, key, x, rows).nearest(queries)


def lof_tables(near: DataFrame, key: str = "id") -> DataFrame:
    """key, kdist, lrd of training rows, from their neighbours among themselves (Breunig et al. 2000)."""
    kdist = near.groupBy(key).agg(F.max("distance").alias("kdist"))
    return kdist.join(lrd(near, kdist, key), key)


def lrd(near: DataFrame, kdist: DataFrame, key: str = "id") -> DataFrame:
    """key, lrd: one over the mean reachability distance to the neighbours."""
    reach = near.join(kdist.select(F.col(key).alias("neighbour"), F.col("kdist").alias("_k")), "neighbour").withColumn("reach", F.greatest("_k", "distance"))
    return reach.groupBy(key).agg((1.0 / (F.mean("reach") + 1e-10)).alias("lrd"))


def lof_scores(near: DataFrame, tables: DataFrame, key: str = "id") -> DataFrame:
    """key, lof: mean density of the neighbours over the row's own."""
    own = lrd(near, tables.select(key, "kdist"), key)
    around = near.join(tables.select(F.col(key).alias("neighbour"), F.col("lrd").alias("_l")), "neighbour").groupBy(key).agg(F.mean("_l").alias("_around"))
    return own.join(around, key).select(key, (F.col("_around") / F.col("lrd")).alias("lof"))


def fit_lof(train: DataFrame, k: int = 5, contamination: float = 0.05, key: str = "id", x: str = "x", search: NeighbourSearch | None = None) -> tuple[DataFrame, float]:
    """(tables of the training rows, offset): the offset is the quantile of their own scores that leaves the contamination above it."""
    near = kept((search or NeighbourSearch(train, k, key, x)).nearest(train))
    tables = kept(lof_tables(near, key))
    offset = quantiles(lof_scores(near, tables, key), [], "lof", [1 - contamination]).first().q
    return tables, float(offset[0]) if offset else 0.0


def lof(queries: DataFrame, train: DataFrame, fitted: tuple[DataFrame, float], k: int = 5, key: str = "id", x: str = "x", threshold: float = 0.0, search: NeighbourSearch | None = None) -> DataFrame:
    """queries with anomaly_score (LOF less the offset) and is_anomaly (score above the threshold, 0 or 1); null without neighbours."""
    tables, offset = fitted
    # equal vectors have equal scores and are searched once, but for training rows, which don't count as their own neighbours
    own = train.select(key, F.lit(True).alias("_own"))
    queries = kept(queries.join(own, key, "left").withColumn("_own", F.when(F.col("_own"), F.col(key))))
    asked = kept(queries.filter(F.col(x).isNotNull()).groupBy(x, "_own").agg(F.min(key).alias(key)))
    near = kept((search or NeighbourSearch(train, k, key, x)).nearest(asked))
    score = lof_scores(near, tables, key).select(key, F.round(F.col("lof") - offset, 6).alias("anomaly_score"))
    found = asked.join(score, key).select(F.col(x).alias("_x"), F.col("_own").alias("_o"), "anomaly_score")
    out = queries.join(found, (F.col(x) == F.col("_x")) & F.col("_own").eqNullSafe(F.col("_o")), "left").drop("_x", "_o", "_own")
    return flags(out, threshold)


def flags(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    return df.withColumn("is_anomaly", (F.col("anomaly_score") > threshold).cast("int"))


# Isolation forest.

NODES = "tree int, node int, feature int, cut double, low int, high int, size long"


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(train: DataFrame, trees: int = 50, sample: int = 256, key: str = "id", x: str = "x", seed: int = 0) -> DataFrame:
    """Node table of the trees (Liu et al. 2008). Each tree takes about ``sample`` rows by hash and grows in its own group."""
    n = max(train.count(), 1)
    part = F.pmod(F.xxhash64(key, F.col("tree"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = train.select(key, x, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).filter(part < min(1.0, sample / n))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key).head(4 * sample)
        tree, rows = int(group["tree"].iloc[0]), np.stack(group[x].to_numpy())
        rng = np.random.default_rng([seed, tree])
        deepest, out, todo = int(np.ceil(np.log2(max(len(rows), 2)))), [], [(0, rows, 0)]
        count = 1
        while todo:
            node, part, depth = todo.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0))
            if depth >= deepest or len(part) <= 1 or not len(spread):
                out.append((tree, node, -1, 0.0, -1, -1, len(part)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] < cut
            out.append((tree, node, f, cut, count, count + 1, len(part)))
            todo += [(count, part[low], depth + 1), (count + 1, part[~low], depth + 1)]
            count += 2
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "low", "high", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, NODES)


def _different(xs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The different vectors of a batch, and the place of each row's among them: equal ones are scored once."""
    if not len(xs):
        return np.empty((0, 0)), np.empty(0, np.int64)
    rows, back = np.unique(np.stack(xs.to_numpy()), axis=0, return_inverse=True)
    return rows, back.reshape(-1)


def forest_scores(df: DataFrame, nodes: DataFrame, x: str = "x", out: str = "anomaly_score") -> DataFrame:
    """df with 2 ** (-mean path / expected path), over 0.5 for rows that are split off early. The node table is bounded by trees and sample."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    trees = [(g["feature"].to_numpy(), g["cut"].to_numpy(), g["low"].to_numpy(), g["high"].to_numpy(), np.array([_average_path(s) for s in g["size"]])) for _, g in table.groupby("tree")]
    whole = _average_path(float(table.loc[table["node"] == 0, "size"].mean())) if len(table) else 1.0
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        rows, back = _different(xs)
        total = np.zeros(len(rows))
        for feature, cut, low, high, rest in shared.value:
            at, depth = np.zeros(len(rows), int), np.zeros(len(rows))
            while (on := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                down = np.where(rows[np.arange(len(rows)), f] < cut[at], low[at], high[at])
                at, depth = np.where(on, down, at), depth + on
            total += depth + rest[at]
        return pd.Series((2 ** (-(total / max(len(shared.value), 1)) / max(whole, 1e-9)))[back])

    return df.withColumn(out, F.round(score(F.col(x)), 6))


# One-class SVM over random Fourier features.


def fit_svm(train: DataFrame, nu: float = 0.05, gamma: float = 0.5, features: int = 64, iterations: int = 15, x: str = "x", seed: int = 0) -> dict:
    """Approximate one-class SVM with a Gaussian kernel: each iteration sums subgradients over all rows in the tasks."""
    dims = len(train.select(x).first()[0])
    rng = np.random.default_rng(seed)
    turn, shift = rng.standard_normal((dims, features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, features)
    w, rho = np.zeros(features), 0.0

    def sums(state):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, rho = state
            total, n, inside = np.zeros(features), 0, 0
            for part in parts:
                if len(part):
                    z = np.sqrt(2 / features) * np.cos(np.stack(part[x].to_numpy()) @ turn + shift)
                    low = z @ w < rho
                    total, n, inside = total + z[low].sum(0), n + len(z), inside + int(low.sum())
            yield pd.DataFrame({"g": [total.tolist()], "n": [n], "low": [inside]})

        return run

    rows = train.select(x)
    mean = rows.mapInPandas(sums((w, 1.0)), "g array<double>, n long, low long").agg(F.sum("n").alias("n"), *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(features)]).first()
    n = max(mean.n or 0, 1)
    w = np.array([mean[f"g{i}"] or 0.0 for i in range(features)]) / n
    rho = float(w @ w)
    for step in range(1, iterations + 1):
        r = rows.mapInPandas(sums((w, rho)), "g array<double>, n long, low long").agg(F.sum("low").alias("low"), *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(features)]).first()
        g, rate = np.array([r[f"g{i}"] or 0.0 for i in range(features)]) / (nu * n), 1.0 / (step + 5)
        w, rho = w - rate * (w - g), rho - rate * rho * ((r.low or 0) / (nu * n) - 1) * 0.5
    return {"turn": turn, "shift": shift, "w": w, "rho": rho}


def svm_scores(df: DataFrame, model: dict, x: str = "x", out: str = "anomaly_score") -> DataFrame:
    """df with rho less the projection: above 0 outside the learned region."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        m = shared.value
        rows, back = _different(xs)
        z = np.sqrt(2 / len(m["w"])) * np.cos(rows @ m["turn"] + m["shift"])
        return pd.Series((m["rho"] - z @ m["w"])[back])

    return df.withColumn(out, F.round(score(F.col(x)), 6))


# Choice of detectors.


def detector_scores(name: str, train: DataFrame, queries: DataFrame, key: str = "id", **options) -> DataFrame:
    """queries with anomaly_score of the named detector fitted on train."""
    if name == "local_outlier_factor":
        k = options.get("k", 5)
        search = NeighbourSearch(train, k, key)
        return lof(queries, train, fit_lof(train, k, options.get("contamination", 0.05), key, search=search), k, key, search=search)
    if name == "isolation_forest":
        return forest_scores(queries, fit_forest(train, options.get("trees", 50), options.get("sample", 256), key))
    if name == "one_class_svm":
        return svm_scores(queries, fit_svm(train, options.get("nu", 0.05), options.get("gamma", 0.5)))
    raise ValueError(f"unknown detector: {name}")


def grid_search(name: str, train: DataFrame, valid: DataFrame, positive: Column, grid: dict[str, list], key: str = "id") -> DataFrame:
    """options (JSON), auc of every combination; each fit is a distributed job."""
    import json

    rows = []
    for values in product(*grid.values()):
        options = dict(zip(grid, values))
        rows.append((json.dumps(options, sort_keys=True), auc(detector_scores(name, train, valid, key, **options), "anomaly_score", positive).first()[0]))
    return train.sparkSession.createDataFrame(rows, "options string, auc double")


def compare_detectors(train: DataFrame, valid: DataFrame, positive: Column, names: list[str], key: str = "id") -> DataFrame:
    """detector, auc, fpr, detection_rate at the 95th percentile of the benign scores."""
    from trafficwarden.operators.metrics import matched_fpr

    rows = []
    for name in names:
        scores = detector_scores(name, train, valid, key).cache()
        m = matched_fpr(scores, "anomaly_score", positive).first()
        rows.append((name, auc(scores, "anomaly_score", positive).first()[0], m.fpr, m.detection_rate))
        scores.unpersist()
    return train.sparkSession.createDataFrame(rows, "detector string, auc double, fpr double, detection_rate double")


def best(table: DataFrame, name: str, value: str) -> DataFrame:
    """The row of the largest value; ties to the first name."""
    return table.orderBy(F.desc(value), name).limit(1)


def zero_day_runs(train: DataFrame, test: DataFrame, label: str, classes: list[int], scores: DataFrame, key: str = "id", text: str = "query_canonical", threshold: float = 0.0, vocabulary: int = VOCABULARY, iterations: int = 100) -> DataFrame:
    """For each held-out class: what a classifier trained without it makes of its tested rows, how often that and the detector catch them, and f1_macro on the tested rows of the other classes.

    Training rows are counted by text and class once for all classes. So are the tested rows, with
    those that the detector flags among them, and each pair is scored once a model.
    """
    from functools import reduce

    from trafficwarden.operators.metrics import zero_day

    different = counted_rows(train, text, label)
    pair, none = [F.col(text).cast("string").alias(text), F.col(label).alias(label), F.col("label_name").alias("label_name")], F.lit(0).cast("long")
    judged = test.join(scores.select(key, "anomaly_score"), key, "left")
    flagged = F.count_if(F.coalesce(F.col("anomaly_score") > threshold, F.lit(False)))
    both = test.groupBy(*pair).agg(F.count("*").alias("_rows"), none.alias("_judged"), none.alias("_flagged")).unionByName(judged.groupBy(*pair).agg(none.alias("_rows"), F.count("*").alias("_judged"), flagged.alias("_flagged")))
    sums = ["_rows", "_judged", "_flagged"]
    asked = kept(spread(both.groupBy(text, label, "label_name").agg(*[F.sum(c).alias(c) for c in sums])))

    def run(c: int) -> DataFrame:
        model = fit_counted(different.filter(F.col("_y") != c), text, vocabulary, iterations)
        return kept(classify(model, asked, text).groupBy((F.col(label) == c).alias("_held"), "label_name", "predicted").agg(*[F.sum(n).alias(n) for n in sums]))  # a row for each pair of classes

    out = []
    for cells in side_by_side([partial(run, c) for c in classes], different.count()):
        rest = summary(confusion(cells.filter(~F.col("_held")), rows="_rows")).select("f1_macro")  # one row
        out.append(zero_day(cells.filter("_held and _judged > 0"), "label_name", "predicted", F.col("_flagged"), "_judged").join(F.broadcast(rest)))
    return reduce(DataFrame.unionByName, out)


def impact(current: DataFrame, cleaned: DataFrame, positive: Column, score: str = "anomaly_score", threshold: float = 0.0) -> DataFrame:
    """pool, fpr, detection_rate, and p50, p90, p99, largest and mean benign score, for the same rows scored by detectors of two pools; a third row holds cleaned less current."""
    measures = ["fpr", "detection_rate", "p50", "p90", "p99", "largest", "mean"]

    def one(df: DataFrame, name: str) -> DataFrame:
        benign = df.filter(~positive)
        q = quantiles(benign, [], score, [0.5, 0.9, 0.99]).select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])
        whole = benign.agg(F.round(F.max(score).cast("double"), 6).alias("largest"), F.round(F.mean(score), 6).alias("mean"))  # one-row tables
        return detector_report(df, F.col(score) > threshold, positive).join(F.broadcast(q)).join(F.broadcast(whole)).select(F.lit(name).alias("pool"), *measures)

    both = kept(one(current, "current").unionByName(one(cleaned, "cleaned")))  # two rows
    of = lambda name, m: F.max(F.when(F.col("pool") == name, F.col(m)))
    return both.unionByName(both.agg(F.lit("difference").alias("pool"), *[F.round(of("cleaned", m) - of("current", m), 6).alias(m) for m in measures]))


def pool_impact(pool: DataFrame, leaked: Column, tested: DataFrame, features: list[str], positive: Column, name: str = "isolation_forest", logged: list[str] | None = None, threshold: float = 0.0, key: str = "id", **options) -> DataFrame:
    """What cleaning a training pool changes: ``impact`` of two fits, with train_rows, leaked_rows and leaked_flagged.

    A detector (and its scaling) is fitted on the whole pool, another without the leaked rows; both
    score the tested rows. leaked_flagged is the share of the leaked rows that the detector of their
    own pool flags, null without such rows. The features are those that ``tested`` and ``pool`` have.
    """
    marked = kept(pool.withColumn("_leaked", F.coalesce(leaked, F.lit(False))))
    scores, sizes = [], []
    for rows in (marked, marked.filter(~F.col("_leaked"))):
        scaling = fit_scaling(rows, features, logged)
        train = scaled(rows, scaling)
        asked = scaled(tested, scaling).withColumn("_pool", F.lit(False)).select(key, "x", "_pool", positive.alias("_positive")).unionByName(train.filter("_leaked").select(key, "x", F.lit(True).alias("_pool"), F.lit(False).alias("_positive")))
        asked = asked.withColumn("_row", F.concat(F.when(F.col("_pool"), "pool:").otherwise("tested:"), F.col(key).cast("string")))  # an id may be in both
        found = detector_scores(name, train.withColumn("_row", F.concat(F.lit("pool:"), F.col(key).cast("string"))), asked, "_row", **options)
        scores.append(kept(found))
        sizes.append(rows.agg(F.count("*").alias("train_rows"), F.count_if("_leaked").alias("leaked_rows")))
    table = impact(*[s.filter(~F.col("_pool")) for s in scores], F.col("_positive"), threshold=threshold)
    flagged = scores[0].filter("_pool").agg(F.round(F.mean((F.col("anomaly_score") > threshold).cast("double")), 6).alias("leaked_flagged"))
    more = [s.withColumn("pool", F.lit(n)) for n, s in zip(("current", "cleaned"), sizes)]
    sizes = more[0].join(F.broadcast(flagged)).unionByName(more[1].withColumn("leaked_flagged", F.lit(None).cast("double")))
    return table.join(F.broadcast(sizes), "pool", "left")  # two rows


def detector_importance(train: DataFrame, tested: DataFrame, features: list[str], positive: Column, logged: list[str] | None = None, trees: int = 50, sample: int = 256, key: str = "id") -> DataFrame:
    """feature, drop: how much AUC a fitted isolation forest loses on the tested rows when one feature is shuffled among them."""
    scaling = fit_scaling(train, features, logged)
    nodes = kept(fit_forest(scaled(train, scaling), trees, sample, key))  # bounded by trees and sample
    return permutation_importance(tested, features, key, lambda df: forest_scores(scaled(df, scaling), nodes, out="score"), positive)


# Persistence.


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


