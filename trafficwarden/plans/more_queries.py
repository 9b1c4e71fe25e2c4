"""Queries of readers, ledgers, reports, session leakage, run ids, further streams and the training workflow.

Readers and sinks work on rows of the tables, written to the shared folder in the source's own form.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as K

from trafficwarden.functions import features as X
from trafficwarden.functions import text as T
from trafficwarden.operators import audit as A
from trafficwarden.operators import curate as C
from trafficwarden.operators import lifecycle as L
from trafficwarden.operators import metrics as E
from trafficwarden.operators import models as M
from trafficwarden.operators.order import kept
from trafficwarden.plans import stream_queries, workflow
from trafficwarden.plans.curation_queries import ranked_sql
from trafficwarden.plans.model_queries import _corpus
from trafficwarden.plans.pours import two_pours
from trafficwarden.plans.stream_queries import _folder, _rows, closed, in_order
from trafficwarden.plans.text_queries import URL
from trafficwarden.plans.traffic import SCORED_SQL, scored, traffic, traffic_sql
from trafficwarden.sources import readers as S
from trafficwarden.sources.readers import read_ledger
from trafficwarden.sources.versions import VersionLedger
from trafficwarden.streaming import jobs as J

CSV = {"quote": '"', "escape": '"'}


# Readers.


def _labelled(s, d):
    """Text and flag; a seventh of the clients has a flag that is neither 0 nor 1."""
    path = _folder(s)
    flag = F.when(F.col("client") % 7 == 0, "2").otherwise(F.col("is_attack").cast("int").cast("string"))
    traffic(s, d).select("query_raw", flag).write.csv(path, **CSV)
    return S.labelled_csv(s, path)


def _payloads(s, d):
    path = _folder(s)
    traffic(s, d).filter("is_attack").select("query_raw").write.text(path)
    return S.payload_files(s, path)


def _multilabel(s, d):
    """Request and body with two flags; every eleventh row has neither."""
    path, on = _folder(s), F.col("id") % 11 != 0
    columns = ["request", "body", "000 - Normal", "66 - SQL Injection"]
    flags = [(on & c).cast("int").cast("string") for c in (~F.col("is_attack"), F.col("is_attack"))]
    body = F.concat(F.lit("c%3D"), F.col("client").cast("string"))
    traffic(s, d).select(*[c.alias(n) for c, n in zip([F.col("query_raw"), body, *flags], columns)]).write.csv(path, header=True, **CSV)
    return S.multilabel_csv(s, path, columns, "request", "body")


def _requests(s, d):
    head = F.format_string("%s /s?id=%d HTTP/1.1\nHost: h%d\n\n", F.when(F.col("is_attack"), "POST").otherwise("GET"), "id", "client")
    text = F.concat(head, F.when(F.col("is_attack"), F.concat(F.lit("v="), F.floor("value").cast("string"))).otherwise(""))
    split = F.when(F.col("client") % 3 == 0, "test").otherwise("train")
    return traffic(s, d).select("id", text.alias("raw_request"), F.when(F.col("is_attack"), "attack").otherwise("normal").alias("label"), split.alias("split"))


def _dump(s, d):
    path = _folder(s)
    _requests(s, d).select("raw_request").write.text(path)
    return S.http_dump(s, path).select("raw_request")


def _na(s, d):
    path = _folder(s)
    k = F.col("c_custkey") % 4
    word = F.when(k == 0, "NA").when(k == 1, "null").when(k == 2, "").otherwise(F.col("c_name"))
    s.read.parquet(f"{d}/customer.parquet").select("c_custkey", word.alias("word")).write.csv(path, header=True, emptyValue='""', **CSV)
    return S.csv_keep_na(s, path, K.StructType([K.StructField("c_custkey", K.LongType()), K.StructField("word", K.StringType())]))


LEDGER = K.StructType([K.StructField("id", K.LongType()), K.StructField("action", K.StringType())])


def _ledger(s, d):
    """Two appends, and lines that aren't JSON between them."""
    path, rows = _folder(s), scored(s, d).select("id", F.col("predicted").alias("action"))
    S.append_ledger(rows.filter("id % 2 = 0"), path)
    s.createDataFrame([("no json",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    S.append_ledger(rows.filter("id % 2 = 1"), path)
    return S.read_ledger(s, path, LEDGER)


def _no_ledger(s, d):
    """What a missing ledger adds to an existing one: nothing."""
    rows = scored(s, d).select("id", F.col("predicted").alias("action"))
    return rows.unionByName(S.read_ledger(s, _folder(s), LEDGER)).groupBy("action").agg(F.count("*").alias("n"))


def _reports(s, d):
    """A metric table by way of both sinks."""
    table, out = scored(s, d).groupBy("label_name").agg(F.count("*").alias("n")), []
    for form in ("json", "csv"):
        path = _folder(s)
        S.write_report(table, path, form)
        reader = s.read.schema(table.schema)
        out.append((reader.json(path) if form == "json" else reader.option("header", True).csv(path)).withColumn("form", F.lit(form)))
    return reduce(DataFrame.unionByName, out)


def _dataset(s, d):
    """Rows written in folders by split and read back."""
    path = _folder(s)
    S.write_dataset(C.split_by_entity(traffic(s, d), "client", 0.3).select("id", "query_raw", "split"), path)
    return s.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


# Text, sessions, runs.


def _fragments(s, d):
    rows = traffic(s, d).select("id", "query_raw", T.fragments(F.col("query_raw"), 4).alias("f"))
    return rows.select("id", F.size("f").alias("n"), F.array_contains(F.transform("f", lambda p: F.trim(p) == ""), True).alias("blank"), F.regexp_replace(F.array_join("f", ""), r"\s+", "").alias("joined"))


def _day_sessions(s, d):
    """A session for each client and day, whole on one side of the split."""
    name = F.concat_ws(":", F.col("client").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    rows = traffic(s, d).withColumn("session_id", name).withColumn("step_index", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "id")) - 1)
    labels = rows.groupBy("session_id").agg(F.max(F.col("is_attack").cast("int")).alias("session_label"))
    return C.split_by_entity(rows.join(labels, "session_id"), "session_id", 0.3).withColumnRenamed("query_raw", "query_canonical")


def _timings(s, d):
    return E.latency(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", "l_quantity")


def _runs(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    config = F.to_json(F.struct(F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("arm")))
    return L.run_ids(o.select("o_orderkey", config.alias("config"), F.md5(F.col("o_orderkey").cast("string")).alias("data_hash"), (F.col("o_orderkey") % 5).alias("seed"))).select("o_orderkey", "run_id")


def _reset(s, d):
    n = s.read.parquet(f"{d}/supplier.parquet")
    versions = n.select(F.concat_ws(".", F.col("s_nationkey") + 1, "s_suppkey").alias("version"), (F.col("s_suppkey") % 9 == 0).alias("protected"))
    rounds = scored(s, d).select("id", F.concat(F.lit("r"), F.col("client") % 5).alias("round_id"))
    rows, left = L.reset(rounds, versions, "r3")
    return rows.select(F.lit("row").alias("kind"), F.col("id").cast("string").alias("name")).unionByName(left.select(F.lit("version").alias("kind"), F.col("version").alias("name")))


def _merged(s, d):
    """Two logs with different columns as one, in order of time."""
    queries = traffic(s, d).select(F.col("ts").alias("at"), F.col("id"), "query_raw")
    decisions = scored(s, d).select((F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("at"), F.col("id"), "predicted")
    return L.merged_log({"query": queries, "decision": decisions}, "at", ["id"]).select("position", "log", "id", "query_raw", "predicted")


def _mixed_validation(s, d):
    return C.mixed_validation(scored(s, d), F.col("is_attack"), "id", 0.2, 300, 4).select("id", "split")


# Streams.


def _stream(s, rows, job):
    """What a job gives for rows that arrive in order of ts."""
    base = _folder(s)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(in_order(rows, base))
    J.run_to_end(job(stream), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out")


def _window_psi(s, d):
    rows = closed(_rows(s, d).select("id", "ts", "score"))
    return _stream(s, rows, lambda x: J.window_psi(x, [0.25, 0.5, 0.75], [0.25, 0.25, 0.25, 0.25])).select("start", "n", "psi")


def _rates(s, d):
    return _stream(s, closed(_rows(s, d)), J.window_rates)


def _breaches(s, d):
    """Mean scores of windows of each source as a stream of signals."""
    means = scored(s, d).groupBy(F.col("source").alias("signal"), F.floor(F.col("position") / 50).alias("window")).agg(F.round(F.mean("score"), 6).alias("psi"))
    rows = means.withColumn("ts", F.timestamp_seconds(F.col("window")))
    return _stream(s, rows.select("ts", "window", "signal", "psi"), lambda x: J.sustained_breaches(x, 0.6, 2))


def _holds(s, d):
    """Every tenth row is held; every twentieth is approved two minutes later, the other thirtieths after ten."""
    held = _rows(s, d).select("id", "ts").filter("id % 10 = 0")
    late = held.filter("id % 30 = 0 and id % 20 <> 0").select("id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), F.lit("approved").alias("kind"))
    soon = held.filter("id % 20 = 0").select("id", (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("ts"), F.lit("approved").alias("kind"))
    rows = closed(held.withColumn("kind", F.lit("hold")).unionByName(late).unionByName(soon))
    return _stream(s, rows, J.hold_timeouts).filter("id >= 0")


def _triggers(s, d):
    rows = scored(s, d).select("ts", "id", F.concat(F.lit("r"), F.col("client") % 37).alias("round_id"))
    return _stream(s, rows, lambda x: J.retrain_triggers(x, 30)).select("round_id")


def _late(s, d):
    """Rows before 15 January, counted by the query's own metrics."""
    base = _folder(s)
    rows = _rows(s, d).select("id", "ts")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(in_order(rows, base))
    return J.late_counts(stream, F.lit("2024-01-15").cast("timestamp"), f"{base}/state")


# Workflow.


#: The operators' own numbers of n-grams and iterations.
CONFIG = {"vocabulary": M.VOCABULARY, "iterations": 100}


def _golden(s, d):
    rows = _corpus(s, d).select("id", "query_canonical", "label", "split")
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


def _sealed(s, d):
    """A run, the same again (reported, not repeated), and one with more rows of known classes (a minor version)."""
    root, (train, golden) = _folder(s), _golden(s, d)
    some, more = train.filter("id % 7 > 0"), train.filter("id % 7 = 0").withColumn("confirmed_at", F.timestamp_seconds("id"))
    runs = [workflow.train_and_seal(s, root, some, extra, golden, CONFIG) for extra in (None, None, more)]
    sealed = VersionLedger(s, f"{root}/versions").versions().select("version", "parent", "n_rows")
    rows = s.createDataFrame([(i, r["version"], r["bump"], r["rows"], r["train_rows"], r["valid_rows"], r["f1_macro"], r["repeated"]) for i, r in enumerate(runs)], "run int, version string, bump string, rows long, train_rows long, valid_rows long, f1_macro double, repeated boolean")
    return rows.join(F.broadcast(sealed), "version")  # a row a version


def _on_golden(s, d):
    """The champion that the stage log names, looked up with the version of its data, on the golden rows and those of a class it never saw."""
    root, (train, golden) = _folder(s), _golden(s, d)
    run = workflow.train_and_seal(s, root, train.filter("label < 5"), None, golden.filter("label < 5"), CONFIG)
    log = s.createDataFrame([(1, "branch1", "promote", run["version"])], "at long, branch string, action string, version string")
    active = L.resolve_active(log, s.createDataFrame([("branch1", "none")], "branch string, version string")).first().version
    known = read_ledger(s, f"{root}/runs", workflow.RUNS).filter(F.col("version") == active).first()
    e = workflow.evaluate_on_golden(M.load_model(known.model), golden.filter("label < 5"), golden.filter("label = 5"))
    return e.select(F.lit(known.version).alias("data_version"), F.lit(known.run_id).alias("run_id"), "f1_macro", "fpr", "n_rows")


def _arms(s, d):
    train, golden = _golden(s, d)
    return workflow.ablation_arms(train.filter("label < 5"), train.filter("label = 5"), golden, CONFIG)


def _scenario(s, d):
    names = ["length", "special_char_ratio"]
    corpus = kept(X.with_features(_corpus(s, d).select("id", "query_canonical", "label"), names=names))
    return workflow.scenario(s, _folder(s), corpus, names, 100, CONFIG)


def _two_pours(s, d):
    """Stacked queries are the new class; thresholds follow the size of the table."""
    names = ["length", "special_char_ratio"]
    corpus = kept(X.with_features(_corpus(s, d).select("id", "query_canonical", "label"), names=names))
    n = corpus.count()
    return two_pours(s, _folder(s), corpus, names, CONFIG, new_class=5, needed=max(1, n // 100), shadow=max(1, n // 20), window=max(10, n // 100))


QUERIES = {
    "s1_labelled_csv": _labelled,
    "s2_payload_files": _payloads,
    "s3_multilabel_csv": _multilabel,
    "s4_http_dump": _dump,
    "s5_http_requests": lambda s, d: S.http_requests(_requests(s, d), "train"),
    "s6_csv_keep_na": _na,
    "s7_write_dataset": _dataset,
    "s8_ledger": _ledger,
    "s9_missing_ledger": _no_ledger,
    "s11_reports": _reports,
    "p17_fragments": _fragments,
    "p35_prefixed_columns": lambda s, d: (lambda t: t.select("l_orderkey", *X.columns_by_prefix(t, "l_line")))(s.read.parquet(f"{d}/lineitem.parquet")),
    "j6_session_leakage": lambda s, d: A.session_leakage(_day_sessions(s, d)),
    "a35_latency": _timings,
    "g7_run_ids": _runs,
    "q8_reset": _reset,
    "l3_merged_log": _merged,
    "m18_mixed_validation": _mixed_validation,
    "st2_streamed_rates": _rates,
    "st3_window_psi": _window_psi,
    "st4_sustained_breaches": _breaches,
    "st5_hold_timeouts": _holds,
    "st7_retrain_triggers": _triggers,
    "st8_late_rows": _late,
    "g11_train_and_seal": _sealed,
    "g12_evaluate_on_golden": _on_golden,
    "g13_ablation_arms": _arms,
    "g14_scenario": _scenario,
    "g14_two_pours": _two_pours,
}

_T = f"WITH {traffic_sql()}"
_SC = f"WITH {SCORED_SQL}"
_URL1 = URL.format("query_raw || ' c%3D' || client")
SQL = {
    "s1_labelled_csv": f"{_T} SELECT DISTINCT trim(query_raw) AS raw_text, is_attack, 'd1' AS source FROM traffic WHERE client % 7 <> 0",
    "s2_payload_files": f"{_T} SELECT DISTINCT trim(query_raw) AS raw_text, true AS is_attack, 'd4' AS source FROM traffic WHERE is_attack",
    "s3_multilabel_csv": f"{_T} SELECT trim({_URL1}) AS raw_text, is_attack, 'd7' AS source FROM (SELECT id, trim(query_raw) AS query_raw, client, is_attack FROM traffic) WHERE id % 11 <> 0",
    "s4_http_dump": f"{_T} SELECT CASE WHEN is_attack THEN 'POST' ELSE 'GET' END || ' /s?id=' || id || ' HTTP/1.1' || chr(10) || 'Host: h' || client || CASE WHEN is_attack THEN chr(10) || chr(10) || 'v=' || CAST(floor(value) AS BIGINT) ELSE '' END AS raw_request FROM traffic",
    "s5_http_requests": f"{_T} SELECT trim('/s?id=' || id || CASE WHEN is_attack THEN ' v=' || CAST(floor(value) AS BIGINT) ELSE '' END) AS raw_text, is_attack, 'd3' AS source FROM traffic WHERE client % 3 <> 0",
    "s6_csv_keep_na": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE c_name END AS word FROM customer",
    "s7_write_dataset": f"{_T}, s AS (SELECT CASE WHEN CAST('0x' || substr(sha256('0:' || client), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3 THEN 'test' ELSE 'train' END AS split FROM traffic) SELECT split, count(*) AS n FROM s GROUP BY 1",
    "s8_ledger": f"{_SC} SELECT id, predicted AS action FROM scored",
    "s9_missing_ledger": f"{_SC} SELECT predicted AS action, count(*) AS n FROM scored GROUP BY 1",
    "s11_reports": f"{_SC} SELECT label_name, count(*) AS n, form FROM scored, (VALUES ('json'), ('csv')) f(form) GROUP BY ALL",
    "p17_fragments": rf"{_T} SELECT id, CAST(least(4, len(regexp_extract_all(query_raw, '[(),;]|[^\s(),;]+'))) AS INTEGER) AS n, false AS blank, regexp_replace(query_raw, '\s+', '', 'g') AS joined FROM traffic",
    "p35_prefixed_columns": "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem",
    "j6_session_leakage": _T + r""", s0 AS (SELECT *, client || ':' || strftime(ts, '%Y-%m-%d') AS sid FROM traffic),
s AS (SELECT *, CASE WHEN CAST('0x' || substr(sha256('0:' || sid), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3 THEN 'test' ELSE 'train' END AS split, max(CAST(is_attack AS INT)) OVER (PARTITION BY sid) AS lab, nullif(regexp_extract(query_raw, 'username\s*=\s*''([^'']+)''', 1), '') AS target FROM s0),
p AS (SELECT sid, any_value(split) AS split, string_agg(sha256(query_raw), ',' ORDER BY ts, id) AS q FROM s GROUP BY sid)
SELECT (SELECT count(*) FROM p WHERE split = 'test') AS test_sessions, (SELECT count(*) FROM p WHERE split = 'test' AND q IN (SELECT q FROM p WHERE split = 'train')) AS same_sequence,
  (SELECT count(DISTINCT sid) FROM s a WHERE split = 'test' AND target IS NOT NULL AND EXISTS (SELECT 1 FROM s b WHERE b.split = 'train' AND b.target = a.target AND b.lab = a.lab)) AS shared_target""",
    "a35_latency": "SELECT round(quantile_cont(l_extendedprice * 1000 / l_quantity, 0.5), 6) AS p50_ms, round(quantile_cont(l_extendedprice * 1000 / l_quantity, 0.95), 6) AS p95_ms FROM lineitem",
    "g7_run_ids": """SELECT o_orderkey, substr(sha256('{"config":{"arm":"' || o_orderpriority || '","size":' || o_custkey || '},"data":"' || md5(CAST(o_orderkey AS VARCHAR)) || '","seed":' || o_orderkey % 5 || '}'), 1, 12) AS run_id FROM orders""",
    "q8_reset": f"{_SC} SELECT 'row' AS kind, CAST(id AS VARCHAR) AS name FROM scored WHERE client % 5 <> 3 UNION ALL SELECT 'version', (s_nationkey + 1) || '.' || s_suppkey FROM supplier WHERE s_suppkey % 9 = 0",
    "l3_merged_log": f"WITH {traffic_sql()}, {SCORED_SQL}, u AS (SELECT ts AS tm, 'query' AS log, id, query_raw, NULL AS predicted FROM traffic UNION ALL SELECT ts + INTERVAL 5 MINUTE, 'decision', id, NULL, predicted FROM scored) SELECT row_number() OVER (ORDER BY tm, log, id) - 1 AS position, log, id, query_raw, predicted FROM u",
    "m18_mixed_validation": f"{_SC}, b AS (SELECT id, r, round_even(0.2 * n, 0) AS v FROM {ranked_sql('(SELECT * FROM scored WHERE NOT is_attack)', '', 'id', 4)}), p AS (SELECT id, r FROM {ranked_sql('(SELECT * FROM scored WHERE is_attack)', '', 'id', 4)}) SELECT id, CASE WHEN r > v THEN 'fit' ELSE 'valid' END AS split FROM b WHERE r > v OR r <= 300 UNION ALL SELECT id, 'valid' FROM p WHERE r <= (SELECT least(max(v), 300) FROM b)",
    "st2_streamed_rates": stream_queries.SQL["st2_window_rates"],
    "st3_window_psi": f"{_SC}, w AS (SELECT date_trunc('day', ts) AS start, count(*) AS n, [count(*) FILTER (score < 0.25), count(*) FILTER (score >= 0.25 AND score < 0.5), count(*) FILTER (score >= 0.5 AND score < 0.75), count(*) FILTER (score >= 0.75)] AS c FROM scored GROUP BY 1), b AS (SELECT start, n, greatest(unnest(c) / CAST(n AS DOUBLE), 1e-6::DOUBLE) AS p FROM w) SELECT start, n, round(sum((p - 0.25::DOUBLE) * ln(p / 0.25::DOUBLE)), 6) AS psi FROM b GROUP BY start, n",
    "st4_sustained_breaches": f"{_SC}, m AS (SELECT source AS signal, position // 50 AS w, round(avg(score), 6) >= 0.6 AS b FROM scored GROUP BY 1, 2), r AS (SELECT signal, w, b AND coalesce(lag(b) OVER (PARTITION BY signal ORDER BY w), false) AS hit FROM m) SELECT signal, CAST(min(w) AS BIGINT) AS \"window\" FROM r WHERE hit GROUP BY signal",
    "st5_hold_timeouts": f"{_SC} SELECT id, CASE WHEN id % 20 = 0 THEN 'approved' ELSE 'deny' END AS outcome FROM scored WHERE id % 10 = 0",
    "st7_retrain_triggers": f"{_SC} SELECT 'r' || (client % 37) AS round_id FROM scored GROUP BY 1 HAVING count(*) >= 30",
    "st8_late_rows": f"{_SC} SELECT CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS BIGINT) AS late, count(*) AS rows FROM scored",
}
