"""Streaming jobs run over the derived traffic as a bounded stream, in batch where the result is the same."""

import time
import uuid
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from trafficwarden.operators import estimators as E
from trafficwarden.operators import lifecycle as L
from trafficwarden.operators import models as M
from trafficwarden.operators.order import kept, shared_folder, spread
from trafficwarden.plans.text_queries import PLAIN, signature_sql, steps_sql, tagged
from trafficwarden.plans.traffic import SCORED_SQL, scored, traffic, traffic_sql
from trafficwarden.streaming import jobs as J


def _folder(s):
    return f"{shared_folder(s)}/{uuid.uuid4().hex}"


def _rows(s, d):
    return traffic(s, d).select("id", "ts", "client", "query_raw", "is_attack").join(scored(s, d).select("id", "predicted", "confidence", "score", "label_name"), "id")


#: Rows of a file of the stream, about; and the fewest files.
FILE_ROWS, FILES = 250_000, 4


def in_order(rows, base, per_file=FILE_ROWS):
    """The folder of rows in files of rising ts: a stream takes files by the time they were written.

    The rows are dealt out in ranges and written in parallel; then the files are given times of writing in
    the order of their ranges, so a slow or repeated task can't let a later range come first. Where the
    store doesn't take such times, each range is copied in its turn instead.
    """
    spark = rows.sparkSession
    rows.write.parquet(f"{base}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    files = max(FILES, -(-kept.count() // per_file))
    dealt = kept.repartitionByRange(files, "ts").sortWithinPartitions("ts")
    dealt.write.option("maxRecordsPerFile", 0).parquet(f"{base}/in")  # a file for each range, numbered by it
    if _dated(spark, f"{base}/in"):
        return f"{base}/in"
    spark.read.schema(rows.schema).parquet(f"{base}/in").withColumn("_range", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")).write.partitionBy("_range").parquet(f"{base}/ranges")
    dealt = spark.read.parquet(f"{base}/ranges").select("_range").distinct().collect()  # a row for each file
    for r in sorted(r["_range"] for r in dealt):
        spark.read.schema(rows.schema).parquet(f"{base}/ranges/_range={r}").coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(f"{base}/copied")
    return f"{base}/copied"


def _dated(spark, folder):
    """Give the files of a folder times of writing that rise with their names; whether the store took them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda p: (len(p.getName()), p.getName()))
    times = [(int(time.time()) - len(files) + i) * 1000 for i in range(len(files))]
    for p, at in zip(files, times):
        store.setTimes(p, at, -1)
    return all(store.getFileStatus(p).getModificationTime() == at for p, at in zip(files, times))


def streamed(job, sort=True):
    """A query that writes the traffic to files in time order, streams them through the job, and reads what came out."""
    def run(s, d):
        base = _folder(s)
        J.run_to_end(job(J.events(s, in_order(_rows(s, d), base), files=2)), f"{base}/out", f"{base}/state")
        return s.read.parquet(f"{base}/out")

    return run


def closed(rows):
    """rows and a last one ten days later, of id -1, which closes all windows before it."""
    last = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 DAYS")).withColumn("id", F.lit(-1).cast("long"))
    return rows.unionByName(last)


def _closed_sessions(s, d):
    base, rows = _folder(s), closed(_rows(s, d))
    J.run_to_end(J.session_rollup(J.events(s, in_order(rows, base), files=2)), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out")


SIZE, EDGES, REF = 250, [0.25, 0.5, 0.75, 1.0], [0.2, 0.2, 0.2, 0.2, 0.2]


def _count_windows(s, d):
    base, rows = _folder(s), _rows(s, d).select("id", "ts", "score")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(in_order(rows, base))
    J.count_window_counts(stream, EDGES, SIZE, f"{base}/counts", f"{base}/state")
    return J.count_window_psi(s, f"{base}/counts", SIZE, REF)


FEATURES = ["length", "special_char_ratio", "entropy", "quote_imbalance"]


def fitted_stages(rows, algorithm="local_outlier_factor"):
    """Canonical form, features, classifier and detector as one saved model, from rows with query_raw, label."""
    text = [E.Canonicalizer(), E.StructuralFeatures(names=FEATURES)]
    ready = kept(PipelineModel(text).transform(rows.select("id", "query_raw", "label")))
    detector = E.AnomalyDetector(algorithm=algorithm, features=FEATURES, logged=["length"]).fit(ready.filter("label = 0"))
    return PipelineModel([*text, E.TextClassifier().fit(ready), detector])


def _model_verdicts(s, d):
    """Verdicts of the promoted models over the stream: one that never saw stacked queries, then, after half of the batches, one that did."""
    base, rows = _folder(s), _rows(s, d)
    train = kept(spread(tagged(s, d).filter("id % 3 = 0").select("id", "query_raw", "label")))

    def fit(version, part):
        fitted_stages(part, "isolation_forest").save(f"{base}/models/{version}")

    M.side_by_side([partial(fit, "1.0", train.filter("label < 5")), partial(fit, "2.0", train)], train.count())
    files, log = in_order(rows, base), [(1, "branch1", "promote", "1.0"), (2, "branch1", "promote", "2.0")]
    batches = []

    def active():
        batches.append(1)
        events = s.createDataFrame(log[: 1 + (len(batches) > 2)], "at long, branch string, action string, version string")
        return L.resolve_active(events, s.createDataFrame([("branch1", "none")], "branch string, version string")).first().version

    job = J.ModelVerdicts(active, lambda v: PipelineModel.load(f"{base}/models/{v}"), f"{base}/out")
    job.run_to_end(J.events(s, files), f"{base}/state")
    return s.read.parquet(f"{base}/out").select("id", "predicted", "is_sqli", "is_anomaly", "action", "version")


QUERIES = {
    "st1_verdicts": lambda s, d: streamed(J.verdicts)(s, d).groupBy("action").agg(F.count("*").alias("n")),
    "st2_window_rates": lambda s, d: J.window_rates(scored(s, d)),
    "st2_sliding_rates": lambda s, d: J.window_rates(scored(s, d), "2 days", "1 day").select("start", "n"),
    "st1_model_verdicts": _model_verdicts,
    "st3_count_windows": _count_windows,
    "st6_sessions": _closed_sessions,
    "st9_once": lambda s, d: streamed(J.once)(s, d).groupBy("client").agg(F.count("*").alias("n")),
}

SQL = {
    "st2_window_rates": f"WITH {SCORED_SQL} SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n, round(avg(CAST(predicted <> 'normal' AS DOUBLE)), 6) AS block_rate, round(avg(CAST(confidence < 0.6 AS DOUBLE)), 6) AS low_confidence, round(avg(confidence), 6) AS mean_confidence FROM scored GROUP BY ALL",
    "st2_sliding_rates": f"WITH {SCORED_SQL} SELECT start, count(*) AS n FROM (SELECT date_trunc('day', ts) AS start FROM scored UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY FROM scored) GROUP BY 1",
    "st1_verdicts": "WITH " + steps_sql() + f" SELECT CASE WHEN {signature_sql('query_canonical')} THEN 'BLOCK' WHEN {PLAIN['special_char_ratio'].replace('t =', 'query_canonical =').replace('(t,', '(query_canonical,').replace('(t)', '(query_canonical)')} > 0.3 THEN 'OVERKILL' ELSE 'ALLOW' END AS action, count(*) AS n FROM canon GROUP BY 1",
    "st3_count_windows": f"""WITH {SCORED_SQL}, w AS (SELECT position // {SIZE} AS "window", CASE {' '.join(f'WHEN score < {e} THEN {i}' for i, e in enumerate(EDGES))} ELSE {len(EDGES)} END AS bin FROM scored),
f AS (SELECT "window", b, greatest(count(*) FILTER (bin = b) / CAST(count(*) AS DOUBLE), 0.000001) AS a FROM w, range({len(REF)}) r(b) GROUP BY "window", b HAVING count(*) = {SIZE}) SELECT "window", round(sum((a - 0.2::DOUBLE) * ln(a / 0.2::DOUBLE)), 6) AS psi FROM f GROUP BY 1""",
    "st6_sessions": f"""WITH {SCORED_SQL}, raw AS (SELECT s.id, s.ts, s.client, s.score, t.query_raw FROM scored s JOIN traffic t USING (id)),
a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER c <= 21600000000 THEN 0 ELSE 1 END AS nw FROM raw WINDOW c AS (PARTITION BY client ORDER BY ts, id)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY client ORDER BY ts, id) AS k FROM a)
SELECT client, min(ts) AS start, count(*) AS steps, string_agg(query_raw, ' ' ORDER BY ts, id) AS session_text, round(avg(score), 6) AS mean_score FROM b GROUP BY client, k""".replace("WITH scored0", "WITH " + traffic_sql() + ", scored0"),
    "st9_once": f"WITH {SCORED_SQL} SELECT client, count(*) AS n FROM scored GROUP BY 1",
}
