"""Queries of curation, samples, splits and audits, over derived traffic and documents."""

from pyspark.sql import functions as F

from trafficwarden.operators import audit as A
from trafficwarden.operators import curate as C
from trafficwarden.operators.order import with_position
from trafficwarden.plans.traffic import SCORED_SQL, scored, traffic, traffic_sql


def key_sql(key: str, seed: int | str = 0) -> str:
    return f"substr(sha256('{seed}:' || CAST({key} AS VARCHAR)), 1, 16)"


def ranked_sql(source: str, by: str, key: str, seed: int = 0) -> str:
    part = f"PARTITION BY {by} " if by else ""
    whole = f"PARTITION BY {by}" if by else ""
    return f"(SELECT *, row_number() OVER ({part}ORDER BY {key_sql(key, seed)}, {key}) AS r, count(*) OVER ({whole}) AS n FROM {source})"


def corpus(s, d):
    """id, query_raw, label_name, source, client: traffic with labels by arithmetic, so that equal texts may disagree."""
    return traffic(s, d).join(scored(s, d).select("id", "label", "label_name", "predicted", "score", "confidence"), "id")


CORPUS = traffic_sql() + ", " + SCORED_SQL + ", corpus AS (SELECT t.*, c.label, c.label_name, c.predicted, c.score, c.confidence FROM traffic t JOIN scored c USING (id))"
SPLIT = f"split AS (SELECT * EXCLUDE (r, n), CASE WHEN r <= round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS split FROM {ranked_sql('corpus', 'label_name', 'id')})"


def split(s, d):
    return C.stratified_split(corpus(s, d), "label_name", "id", 0.2)


def counts(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"))


ENDINGS = [f"; {x}{t}" for x in C.STATEMENTS for t in C.TERMINATORS]
STACKED = traffic_sql() + ", stacked AS (SELECT prefix, unnest(range(" + str(len(ENDINGS)) + ")) AS n, prefix || unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in ENDINGS) + "]) AS payload FROM (SELECT DISTINCT query_raw AS prefix FROM traffic WHERE is_attack))"


def _prefixes(s, d):
    """The different attack texts of the traffic, each to be followed by a second statement."""
    return traffic(s, d).filter("is_attack").select(F.col("query_raw").alias("prefix")).distinct()


def _a10(s, d):
    rows = split(s, d)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    checks = {
        "ids_unique": (rows.groupBy("id").agg(F.count("*").alias("c")).agg(F.max("c").alias("most")), F.col("most") == 1),
        "no_shared_ids": (C.overlap(train, test, "id"), F.col("n") == 0),
        "no_shared_texts": (C.overlap(train, test, "query_raw"), F.col("n") == 0),
    }
    return A.invariants(checks).select("name", "passed")


def _m12(s, d):
    rows = corpus(s, d)
    out = C.replay_stream(rows.filter("label_name = 'normal'"), rows.filter("label between 1 and 4"), rows.filter("label = 5"), "id", 0.1, 0.6, 0.3)
    return out.select("id", "label_name", "phase", "position")


def _m13(s, d):
    rows = corpus(s, d)
    out = C.pours(rows.filter("label_name = 'normal' and client % 2 = 0"), rows.filter("label in (1, 2)"), rows.filter("label in (3, 4)"), rows.filter("label_name = 'normal' and client % 2 = 1"), "id")
    return out.select("id", "chunk", "position")


def _j3(s, d):
    rows = split(s, d)
    return C.overlap(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "query_raw")


QUERIES = {
    "j1_exclude_known": lambda s, d: C.exclude_known(corpus(s, d), [corpus(s, d).filter("client % 3 = 0"), corpus(s, d).filter("client % 5 = 0")], "query_raw").select("id", "query_raw"),
    "j2_consistent": lambda s, d: C.consistent(corpus(s, d), "query_raw", "label_name", ["position"]).select("id", "query_raw", "label_name"),
    "j2_duplicates": lambda s, d: C.duplicates(corpus(s, d), "query_raw", "label_name"),
    "j3_overlap": _j3,
    "j4_truth": lambda s, d: C.with_truth(scored(s, d).select("id", "predicted"), scored(s, d)).groupBy("predicted", "truth").agg(F.count("*").alias("n")),
    "j7_stacked_payloads": lambda s, d: C.stacked_on(_prefixes(s, d), "prefix").select("prefix", "n", "payload"),
    "j9_label_ids": lambda s, d: scored(s, d).join(F.broadcast(s.createDataFrame([("normal", 0), ("union_based", 1), ("error_based", 2), ("boolean_blind", 3), ("time_blind", 4), ("stacked", 5)], "predicted string, label_id int")), "predicted").select("id", "label_id"),
    "f5_flagged": lambda s, d: C.flagged(scored(s, d)).select("id", "review_source"),
    "w1_keep_first": lambda s, d: C.keep_first(corpus(s, d), ["query_raw"], ["position"]).select("id", "query_raw"),
    "w2_keep_last": lambda s, d: C.keep_first(corpus(s, d), ["query_raw"], ["position"], descending=True).select("id", "query_raw"),
    "w9_position": lambda s, d: with_position(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "position"),
    "s7_dataset_ids": lambda s, d: with_position(split(s, d), ["split", "position"], "row_id").select("id", "split", "row_id"),
    "m1_undersample": lambda s, d: counts(C.undersample(s.read.parquet(f"{d}/documents.parquet"), "lang", 40, "doc_id"), "lang", "doc_id"),
    "m2_stratified_split": lambda s, d: split(s, d).select("id", "split"),
    "m3_random_split": lambda s, d: C.random_split(s.read.parquet(f"{d}/documents.parquet"), "doc_id", 0.3, 5).select("doc_id", "split"),
    "m4_partitions": lambda s, d: C.partition_by_fractions(s.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_orderkey", {"train": 0.6, "golden": 0.1, "stream": 0.3}).select("o_orderkey", "partition"),
    "m5_carve": lambda s, d: C.carve(split(s, d), "split", "train", "valid", 0.1, "id", 3).select("id", "split"),
    "m6_held_out": lambda s, d: C.held_out_protocol(corpus(s, d), "label_name", "stacked", "id").select("id", "role"),
    "m7_rebalance_short": lambda s, d: C.rebalance_short(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text", "doc_id", 0.05, 600).select("doc_id"),
    "m8_balance": lambda s, d: C.balance(corpus(s, d), "label_name", "id").select("id", "label_name"),
    "m8_balance_cap": lambda s, d: C.balance(corpus(s, d), "label_name", "id", 20).select("id", "label_name"),
    "m9_rehearsal": lambda s, d: C.rehearsal_pool(corpus(s, d).filter("label < 5"), corpus(s, d).filter("label = 5"), 0.25, "id").select("id"),
    "m10_reservoir": lambda s, d: C.reservoir(corpus(s, d).filter("label = 0"), "id", 100, 9).select("id"),
    "m11_with_replacement": lambda s, d: counts(C.with_replacement(s.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", 50, 2), "s_suppkey"),
    "m12_replay_stream": _m12,
    "m13_pours": _m13,
    "m14_new_class_pool": lambda s, d: C.random_split(C.stacked_on(_prefixes(s, d), "prefix"), "payload", 0.2, 1, ("golden", "stream"), "partition").select("payload", "partition"),
    "m15_entity_split": lambda s, d: C.split_by_entity(traffic(s, d), "client", 0.3).select("id", "split"),
    "m17_equal_groups": lambda s, d: C.equal_groups(scored(s, d), "is_attack", "id").groupBy("is_attack").agg(F.count("*").alias("n"), F.sum("id").alias("ids")),
    "m18_validation_split": lambda s, d: C.random_split(scored(s, d).filter("not is_attack"), "id", 0.2, 4, ("valid", "fit")).select("id", "split"),
    "a1_profile": lambda s, d: A.profile(split(s, d), ["split", "label_name", "source"], ["query_raw"]),
    "a2_duplicate_leakage": lambda s, d: A.duplicate_leakage(split(s, d), "query_raw"),
    "a3_callback_labels": lambda s, d: A.callback_labels(corpus(s, d), "query_raw"),
    "a4_template_rows": lambda s, d: A.template_rows(corpus(s, d), "query_raw"),
    "a5_label_by_split": lambda s, d: A.label_by_split(split(s, d), "label_name", "split", ["train", "test"]),
    "a6_partition_counts": lambda s, d: A.partition_counts(split(s, d), "label_name", "split"),
    "a7_describe": lambda s, d: A.describe(s.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]),
    "a8_score_stats": lambda s, d: A.score_stats(scored(s, d), "score", ["label_name"]),
    "a9_stream_manifest": lambda s, d: A.stream_manifest(corpus(s, d), 300).select("rows", "windows", "attack_rate", "unique_texts", F.element_at("mix", "normal").alias("normal_rows")),
    "a10_invariants": _a10,
    "a11_histogram": lambda s, d: A.histogram(scored(s, d), "score", 0.0, 1.3, 26, ["is_attack"]),
    "a12_density": lambda s, d: A.density(scored(s, d), "score", 0.0, 1.2, 60),
    "u1_union": lambda s, d: counts(traffic(s, d).filter("client % 2 = 0").withColumn("pool", F.lit("even")).unionByName(traffic(s, d).filter("client % 2 = 1").withColumn("pool", F.lit("odd"))), "pool", "source"),
    "u5_text_overlap": lambda s, d: C.overlap(s.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'"), s.read.parquet(f"{d}/documents.parquet").filter("source = 'src0' or source = 'src1'"), "text"),
    "l2_first_rows": lambda s, d: traffic(s, d).orderBy("position").limit(200).select("id", "position"),
}


def _w(body, ctes=CORPUS):
    return f"WITH {ctes} {body}"


def _s(body):
    return _w(body, CORPUS + ", " + SPLIT)


_Q = "CAST(floor(nn / (1 - 0.1)) AS BIGINT)"
SQL = {
    "j1_exclude_known": _w("SELECT id, query_raw FROM corpus WHERE query_raw NOT IN (SELECT query_raw FROM corpus WHERE client % 3 = 0 OR client % 5 = 0)"),
    "j2_consistent": _w(", ok AS (SELECT query_raw FROM corpus GROUP BY 1 HAVING count(DISTINCT label_name) = 1) SELECT id, query_raw, label_name FROM (SELECT *, row_number() OVER (PARTITION BY query_raw ORDER BY position) AS k FROM corpus JOIN ok USING (query_raw)) WHERE k = 1"),
    "j2_duplicates": _w("SELECT query_raw, count(*) AS n, count(DISTINCT label_name) AS labels FROM corpus GROUP BY 1 HAVING count(*) > 1"),
    "j3_overlap": _s("SELECT count(*) AS n FROM (SELECT query_raw FROM split WHERE split = 'train' INTERSECT SELECT query_raw FROM split WHERE split = 'test')"),
    "j4_truth": _w("SELECT predicted, label_name AS truth, count(*) AS n FROM corpus GROUP BY ALL"),
    "j7_stacked_payloads": _w("SELECT prefix, n, payload FROM stacked", STACKED),
    "j9_label_ids": _w("SELECT id, CAST(list_position(['normal', 'union_based', 'error_based', 'boolean_blind', 'time_blind', 'stacked'], predicted) - 1 AS INTEGER) AS label_id FROM scored"),
    "f5_flagged": _w("SELECT id, CASE WHEN predicted <> 'normal' THEN 'block' ELSE 'low_confidence' END AS review_source FROM scored WHERE predicted <> 'normal' OR confidence < 0.6"),
    "w1_keep_first": _w("SELECT arg_min(id, position) AS id, query_raw FROM corpus GROUP BY query_raw"),
    "w2_keep_last": _w("SELECT arg_max(id, position) AS id, query_raw FROM corpus GROUP BY query_raw"),
    "w9_position": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders",
    "s7_dataset_ids": _s("SELECT id, split, row_number() OVER (ORDER BY split, position) - 1 AS row_id FROM split"),
    "m1_undersample": f"SELECT lang, doc_id, count(*) AS n FROM {ranked_sql('documents', 'lang', 'doc_id')} WHERE r <= 40 GROUP BY ALL",
    "m2_stratified_split": _s("SELECT id, split FROM split"),
    "m3_random_split": f"SELECT doc_id, CASE WHEN r <= round_even(0.3 * n, 0) THEN 'test' ELSE 'train' END AS split FROM {ranked_sql('documents', '', 'doc_id', 5)}",
    "m4_partitions": f"SELECT o_orderkey, CASE WHEN r <= round_even(0.6 * n, 0) THEN 'train' WHEN r <= round_even(0.7 * n, 0) THEN 'golden' ELSE 'stream' END AS partition FROM {ranked_sql('orders', 'o_orderpriority', 'o_orderkey')}",
    "m5_carve": _s(f"SELECT id, CASE WHEN r <= round_even(0.1 * n, 0) THEN 'valid' ELSE 'train' END AS split FROM {ranked_sql('(SELECT * FROM split WHERE split = ' + chr(39) + 'train' + chr(39) + ')', '', 'id', 3)} UNION ALL SELECT id, split FROM split WHERE split = 'test'"),
    "m6_held_out": _w(f"SELECT id, CASE WHEN r <= round_even(0.1 * n, 0) THEN 'golden' WHEN label_name = 'stacked' THEN 'held' WHEN r <= round_even(0.1 * n, 0) + floor((n - round_even(0.1 * n, 0)) / 2) THEN 'base' ELSE 'reserve' END AS role FROM {ranked_sql('corpus', 'label_name', 'id')}"),
    "m7_rebalance_short": f"WITH q AS (SELECT round_even(count(*) FILTER (length(text) > 600) * 0.05 / (1 - 0.05), 0) AS q FROM documents) SELECT doc_id FROM documents WHERE length(text) > 600 UNION ALL SELECT doc_id FROM {ranked_sql('(SELECT * FROM documents WHERE length(text) <= 600)', '', 'doc_id')}, q WHERE r <= q",
    "m8_balance": _w(f"SELECT id, label_name FROM {ranked_sql('corpus', 'label_name', 'id')} WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM corpus GROUP BY label_name))"),
    "m8_balance_cap": _w(f"SELECT id, label_name FROM {ranked_sql('corpus', 'label_name', 'id')} WHERE r <= (SELECT least(20, min(c)) FROM (SELECT count(*) AS c FROM corpus GROUP BY label_name))"),
    "m9_rehearsal": _w(f"SELECT id FROM {ranked_sql('(SELECT * FROM corpus WHERE label < 5)', '', 'id')} WHERE r <= round_even(0.25 * n, 0) UNION ALL SELECT id FROM corpus WHERE label = 5"),
    "m10_reservoir": _w(f"SELECT id FROM {ranked_sql('(SELECT * FROM corpus WHERE label = 0)', '', 'id', 9)} WHERE r <= 100"),
    "m11_with_replacement": f"WITH d AS (SELECT CAST('0x' || substr(sha256('2:' || i), 1, 8) AS BIGINT) AS h FROM range(1, 51) t(i)) SELECT s_suppkey, count(*) AS n FROM {ranked_sql('supplier', '', 's_suppkey', 2)} JOIN d ON r = h % n + 1 GROUP BY 1",
    "m12_replay_stream": _w(f""", q0 AS (SELECT CAST(floor(count(*) / (1 - 0.1::DOUBLE)) AS BIGINT) AS t FROM corpus WHERE label = 0), q1 AS (SELECT CAST(round(t * 0.6::DOUBLE) AS BIGINT) AS a, t - CAST(round(t * 0.6::DOUBLE) AS BIGINT) AS b FROM q0),
q AS (SELECT round(a * 0.1::DOUBLE) AS ka, round(b * 0.1::DOUBLE) - round(b * 0.1::DOUBLE * 0.3::DOUBLE) AS kb, round(b * 0.1::DOUBLE * 0.3::DOUBLE) AS nb, a - round(a * 0.1::DOUBLE) AS ba FROM q1),
m AS (SELECT id, label_name, CASE WHEN r <= ba THEN 'A' ELSE 'B' END AS phase FROM {ranked_sql('(SELECT * FROM corpus WHERE label = 0)', '', 'id')}, q
UNION ALL SELECT id, label_name, CASE WHEN r <= ka THEN 'A' WHEN r <= ka + kb THEN 'B' END FROM {ranked_sql('(SELECT * FROM corpus WHERE label BETWEEN 1 AND 4)', '', 'id')}, q
UNION ALL SELECT id, label_name, CASE WHEN r <= nb THEN 'B' END FROM {ranked_sql('(SELECT * FROM corpus WHERE label = 5)', '', 'id')}, q)
SELECT id, label_name, phase, row_number() OVER (ORDER BY phase, {key_sql('id', '0:order')}, id) - 1 AS position FROM m WHERE phase IS NOT NULL"""),
    "m13_pours": _w(f""", k AS (SELECT count(*) FILTER (label IN (1, 2)) AS n1, count(*) FILTER (label IN (3, 4)) AS n2 FROM corpus),
m AS (SELECT id, '0_quiet' AS chunk FROM corpus WHERE label = 0 AND client % 2 = 0 UNION ALL SELECT id, '1_first' FROM corpus WHERE label IN (1, 2) UNION ALL SELECT id, '2_second' FROM corpus WHERE label IN (3, 4)
UNION ALL SELECT id, CASE WHEN r <= floor(n * n1 / CAST(n1 + n2 AS DOUBLE)) THEN '1_first' ELSE '2_second' END FROM {ranked_sql('(SELECT * FROM corpus WHERE label = 0 AND client % 2 = 1)', '', 'id')}, k)
SELECT id, chunk, row_number() OVER (ORDER BY chunk, {key_sql('id', '0:order')}, id) - 1 AS position FROM m"""),
    "m14_new_class_pool": _w(f"SELECT payload, CASE WHEN r <= round_even(0.2 * n, 0) THEN 'golden' ELSE 'stream' END AS partition FROM {ranked_sql('(SELECT payload FROM stacked)', '', 'payload', 1)}", STACKED),
    "m15_entity_split": _w("SELECT id, CASE WHEN CAST('0x' || substr(sha256('0:' || client), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3 THEN 'test' ELSE 'train' END AS split FROM traffic"),
    "m17_equal_groups": _w(f"SELECT is_attack, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM {ranked_sql('scored', 'is_attack', 'id')} WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM scored GROUP BY is_attack)) GROUP BY 1"),
    "m18_validation_split": _w(f"SELECT id, CASE WHEN r <= round_even(0.2 * n, 0) THEN 'valid' ELSE 'fit' END AS split FROM {ranked_sql('(SELECT * FROM scored WHERE NOT is_attack)', '', 'id', 4)}"),
    "a1_profile": _s(" UNION ALL ".join(["SELECT 'rows' AS metric, NULL AS value, count(*) AS n FROM split", "SELECT 'distinct_query_raw', NULL, count(DISTINCT query_raw) FROM split", *[f"SELECT '{c}', {c}, count(*) FROM split GROUP BY 2" for c in ("split", "label_name", "source")]])),
    "a2_duplicate_leakage": _s("SELECT CAST(sum(c - 1) AS BIGINT) AS extra_copies, count(*) FILTER (c > 1) AS duplicated_texts, count(*) FILTER (b) AS straddling FROM (SELECT count(*) AS c, count(DISTINCT split) = 2 AS b FROM split GROUP BY query_raw)"),
    "a3_callback_labels": _w("SELECT label_name, count(*) AS n, count(*) FILTER (contains(lower(query_raw), 'owasp.org')) AS n_0, count(*) FILTER (contains(lower(query_raw), '/etc/passwd')) AS n_1, count(*) FILTER (contains(lower(query_raw), 'shellshock')) AS n_2 FROM corpus WHERE contains(lower(query_raw), 'owasp.org') OR contains(lower(query_raw), '/etc/passwd') OR contains(lower(query_raw), 'shellshock') GROUP BY 1"),
    "a4_template_rows": _w("SELECT label_name, count(*) FILTER (h) AS n, round(count(*) FILTER (h) / CAST(count(*) AS DOUBLE), 6) AS share, count(DISTINCT query_raw) FILTER (h) AS \"distinct\" FROM (SELECT *, contains(query_raw, '/blog/index.php/2020/03') AS h FROM corpus) GROUP BY 1"),
    "a5_label_by_split": _s("SELECT label_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM split GROUP BY 1"),
    "a6_partition_counts": _s("SELECT label_name, split, count(*) AS n FROM split GROUP BY ROLLUP (label_name, split)"),
    "a7_describe": " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, count({c}) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM (SELECT *, CAST({c} AS DOUBLE) AS x FROM lineitem) GROUP BY 1" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "a8_score_stats": _w("SELECT label_name, count(score) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS max FROM scored GROUP BY 1"),
    "a9_stream_manifest": _w("SELECT count(*) AS rows, CAST(ceil(count(*) / 300.0::DOUBLE) AS BIGINT) AS windows, round(avg(CAST(label_name <> 'normal' AS DOUBLE)), 6) AS attack_rate, count(DISTINCT query_raw) AS unique_texts, count(*) FILTER (label_name = 'normal') AS normal_rows FROM corpus"),
    "a10_invariants": _s("SELECT 'ids_unique' AS name, max(c) = 1 AS passed FROM (SELECT count(*) AS c FROM split GROUP BY id) UNION ALL SELECT 'no_shared_ids', count(*) = 0 FROM (SELECT id FROM split WHERE split = 'train' INTERSECT SELECT id FROM split WHERE split = 'test') UNION ALL SELECT 'no_shared_texts', count(*) = 0 FROM (SELECT query_raw FROM split WHERE split = 'train' INTERSECT SELECT query_raw FROM split WHERE split = 'test')"),
    "a11_histogram": _w("SELECT is_attack, CAST(CASE WHEN score = 1.3 THEN 26 ELSE floor(26 * score / 1.3) + 1 END AS INTEGER) AS bin, count(*) AS n FROM scored WHERE score BETWEEN 0 AND 1.3 GROUP BY ALL"),
    "a12_density": _w(", c AS (SELECT greatest(0.0::DOUBLE, least(1.2::DOUBLE, score)) AS v FROM scored), w AS (SELECT count(*) AS total, stddev_samp(v) * pow(count(*), -0.2::DOUBLE) AS h FROM c), g AS (SELECT 0.0::DOUBLE + i * (1.2::DOUBLE / 59) AS x FROM range(60) r(i)) SELECT round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((x - v) / h, 2)) / (h * sqrt(2 * pi())) / total), 6) AS density FROM c, w, g GROUP BY x"),
    "u1_union": _w("SELECT CASE WHEN client % 2 = 0 THEN 'even' ELSE 'odd' END AS pool, source, count(*) AS n FROM traffic GROUP BY ALL"),
    "u5_text_overlap": "SELECT count(*) AS n FROM (SELECT text FROM documents WHERE lang = 'en' INTERSECT SELECT text FROM documents WHERE source IN ('src0', 'src1'))",
    "l2_first_rows": _w("SELECT id, position FROM traffic WHERE position < 200"),
}
