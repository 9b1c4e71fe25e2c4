"""Queries over the text of derived traffic: canonical form, tags, predicates, features, filters."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficwarden.functions import features as X
from trafficwarden.functions import text as T
from trafficwarden.operators import curate as C
from trafficwarden.plans.traffic import traffic, traffic_sql

URL = "url_decode(replace({}, '+', ' '))"
HEX, CHARS = "0x([0-9a-fA-F]{2,})", r"(?i)CHAR\s*\(\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\)"


def _stitched(pieces: str, matches: str, one: str) -> str:
    return f"array_to_string(list_transform(range(len({pieces})), lambda i: {pieces}[i + 1] || CASE WHEN i < len({matches}) THEN {one} ELSE '' END), '')"


_HEX_ONE = "CASE WHEN len(hm[i + 1]) % 2 = 0 AND regexp_full_match(hm[i + 1], '([2-6][0-9a-fA-F]|7[0-9a-eA-E])+') THEN '''' || decode(unhex(hm[i + 1])) || '''' ELSE '0x' || hm[i + 1] END"
_CHAR_ONE = r"'''' || array_to_string(list_transform(string_split_regex(cm[i + 1], '\s*,\s*'), lambda c: chr(CAST(c AS INTEGER))), '') || ''''"
COMMENT = r"CAST(regexp_matches({}, '(?s)/\*.*?\*/|--') AS INTEGER)"


def steps_sql(stream: bool = False) -> str:
    """CTEs up to ``canon``: traffic with query_canonical and has_comment_marker."""
    return traffic_sql(stream) + f""",
u AS (SELECT *, {URL.format(URL.format(URL.format('query_raw')))} AS d FROM traffic),
h0 AS (SELECT *, string_split_regex(d, '0x[0-9a-fA-F]{{2,}}') AS hp, regexp_extract_all(d, '{HEX}', 1) AS hm FROM u),
h AS (SELECT * EXCLUDE (hp, hm), {_stitched('hp', 'hm', _HEX_ONE)} AS x FROM h0),
k0 AS (SELECT *, string_split_regex(x, '{CHARS.replace("([0-9]", "(?:[0-9]")}') AS cp, regexp_extract_all(x, '{CHARS}', 1) AS cm FROM h),
k AS (SELECT * EXCLUDE (cp, cm), {_stitched('cp', 'cm', _CHAR_ONE)} AS c FROM k0),
canon AS (SELECT id, ts, client, value, source, is_attack, query_raw, position, lower(c) AS query_canonical, {COMMENT.format('query_raw')} AS has_comment_marker FROM k)"""


def _rule(column: str, rule: str, case: str = "(?i)") -> str:
    return f"regexp_matches({column}, '{case}{rule.replace(chr(39), chr(39) * 2)}')"


def tag_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_rule(column, r)} THEN {n}" for n, r in T.ATTACK_RULES) + " ELSE 3 END"


def signature_sql(column: str) -> str:
    return "(" + " OR ".join([_rule(column, r) for _, r in T.ATTACK_RULES] + [_rule(column, r) for r in T.OTHER_RULES] + [_rule(column, T.COMMAND_RULE, "")]) + ")"


NAME = "['normal', 'union_based', 'error_based', 'boolean_blind', 'time_blind', 'stacked'][{} + 1]"
CALLBACK = "(contains(lower(query_canonical), 'owasp.org') OR contains(lower(query_canonical), '/etc/passwd') OR contains(lower(query_canonical), 'shellshock'))"


def tagged_sql(stream: bool = False) -> str:
    return steps_sql(stream) + f""",
tagged0 AS (SELECT *, CASE WHEN is_attack THEN {tag_sql('query_canonical')} ELSE 0 END AS label FROM canon),
tagged AS (SELECT *, {NAME.format('label')} AS label_name FROM tagged0)"""


def canon(spark, d, stream=False):
    return T.canonicalize(traffic(spark, d, stream))


def tagged(spark, d, stream=False):
    return T.tagged(canon(spark, d, stream))


def _features(spark, d):
    return X.with_features(canon(spark, d).select("id", "query_canonical"))


def _flagship(spark, d):
    """Per 1000 rows of traffic: rows, attack shares by class, and means of four features."""
    rows = X.with_features(tagged(spark, d, True), names=["length", "special_char_ratio", "entropy", "quote_imbalance"])
    r = lambda c: F.round(F.mean(c), 6)
    return rows.groupBy(F.floor(F.col("position") / 1000).alias("window")).agg(F.count("*").alias("n"), *[r((F.col("label") == i).cast("double")).alias(f"share_{x}") for i, x in enumerate(T.LABELS) if i], r("length").alias("length"), r("special_char_ratio").alias("special_char_ratio"), r("entropy").alias("entropy"), r("quote_imbalance").alias("quote_imbalance"))


ENTROPY = """ch AS (SELECT id, unnest(string_split(t, '')) AS s FROM q WHERE t <> ''), cn AS (SELECT id, s, count(*) AS c FROM ch GROUP BY ALL),
en AS (SELECT id, -sum(c / n * log2(c / n)) AS v FROM (SELECT id, CAST(c AS DOUBLE) AS c, sum(c) OVER (PARTITION BY id) AS n FROM cn) GROUP BY id)"""
BIGRAMS = """bg AS (SELECT id, substr(t, i, 2) AS s FROM (SELECT id, t, unnest(range(1, length(t))) AS i FROM q)), bn AS (SELECT id, s, count(*) AS c FROM bg GROUP BY ALL),
be AS (SELECT id, -sum(c / n * log2(c / n)) AS v FROM (SELECT id, CAST(c AS DOUBLE) AS c, sum(c) OVER (PARTITION BY id) AS n FROM bn) GROUP BY id)"""
ODD = "(length(t) - length(replace(t, '{0}', ''))) % 2"
PLAIN = {
    "length": "length(t)",
    "special_char_ratio": "CASE WHEN t = '' THEN 0.0 ELSE round((length(t) - length(translate(t, '''\";#-=<>()*|%', ''))) / CAST(length(t) AS DOUBLE), 6) END",
    "sql_keyword_count": r"CAST(len(regexp_extract_all(t, '(?i)\b(" + "|".join(X.KEYWORDS) + r")\b')) AS INTEGER)",
    "quote_imbalance": "CAST(" + ODD.format("''") + " + " + ODD.format('"') + " AS DOUBLE)",
    "paren_imbalance": "CAST(" + ODD.format("(") + " + " + ODD.format(")") + " AS DOUBLE)",
    "same_type_run_ratio": r"CASE WHEN length(t) < 2 THEN 0.0 ELSE round((length(t) - len(regexp_extract_all(t, '\s+|[0-9]+|[A-Za-z]+|[^A-Za-z0-9\s]+'))) / CAST(length(t) - 1 AS DOUBLE), 6) END",
    "max_token_length": r"CAST(coalesce(list_max(list_transform(regexp_extract_all(t, '\S+'), lambda s: length(s))), 0) AS INTEGER)",
    "token_count": r"CAST(len(regexp_extract_all(t, '\S+')) AS INTEGER)",
    "max_special_run": r"CAST(coalesce(list_max(list_transform(regexp_extract_all(t, '[^A-Za-z0-9\s]+'), lambda s: length(s))), 0) AS INTEGER)",
    "max_digit_run": "CAST(coalesce(list_max(list_transform(regexp_extract_all(t, '[0-9]+'), lambda s: length(s))), 0) AS INTEGER)",
}
Q = ", q AS (SELECT id, query_canonical AS t FROM canon), "


def _one_feature(name):
    return lambda s, d: X.with_features(canon(s, d).select("id", "query_canonical"), names=[name]).select("id", F.col(name))


def _documents_features(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("query_canonical"))
    return X.with_features(docs, names=["length", "entropy", "bigram_entropy", "special_char_ratio"]).drop("query_canonical")


def _vocabulary(s, d):
    return T.char_vocabulary(canon(s, d), "query_canonical", 40)


def _encoded(s, d):
    v = {r.ch: r.id for r in _vocabulary(s, d).collect()}  # 40 rows
    return canon(s, d).select("id", F.array_join(T.char_ids(F.col("query_canonical"), v, 32), ",").alias("ids"))


def _move(s, d):
    rows = tagged(s, d).select("id", "query_canonical", "source", "is_attack")
    normal, pool = C.move_callbacks(rows.filter("not is_attack"), rows.filter("is_attack"))
    return normal.withColumn("pool", F.lit("normal")).unionByName(pool.withColumn("pool", F.lit("anomalous"))).select("id", "source", "pool")


QUERIES = {
    "flagship_windows": _flagship,
    "s10_traffic": lambda s, d: traffic(s, d).select("id", "client", "position", "source", "is_attack", "query_raw"),
    "p01_canonicalize": lambda s, d: canon(s, d).select("id", "query_canonical", "has_comment_marker"),
    "p02_url_decode": lambda s, d: traffic(s, d).select("id", T.url_decoded(F.col("query_raw")).alias("decoded")),
    "p03_hex_literals": lambda s, d: traffic(s, d).select("id", T.hex_literals(F.col("query_raw")).alias("decoded")),
    "p04_char_calls": lambda s, d: traffic(s, d).select("id", T.char_calls(F.col("query_raw")).alias("decoded")),
    "p05_comment_marker": lambda s, d: traffic(s, d).select("id", T.comment_marker(F.col("query_raw")).alias("has_comment_marker")),
    "p06_lower": lambda s, d: traffic(s, d).select("id", F.lower("query_raw").alias("lowered")),
    "p07_clean": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(T.cleaned(F.col("text"))).alias("md5")),
    "p08_strip_wrapper": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.without_wrapper(F.col("url")).alias("rest")),
    "p09_attack_tag": lambda s, d: canon(s, d).filter("is_attack").select("id", T.attack_tag(F.col("query_canonical")).alias("label")),
    "p10_tag": lambda s, d: tagged(s, d).select("id", "label", "label_name"),
    "p11_any_signature": lambda s, d: canon(s, d).select("id", T.any_signature(F.col("query_canonical")).alias("matched")),
    "p11_pages_signature": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.any_signature(F.col("html")).alias("matched")),
    "p12_callback": lambda s, d: canon(s, d).select("id", T.is_callback(F.col("query_canonical")).alias("matched")),
    "p13_template": lambda s, d: canon(s, d).select("id", T.is_template(F.col("query_canonical")).alias("matched")),
    "p14_probe_target": lambda s, d: canon(s, d).select("id", T.probe_target(F.col("query_canonical")).alias("target")),
    "p15_label_names": lambda s, d: tagged(s, d).select("id", T.label_name(F.when(F.col("id") % 2 == 0, F.col("label").cast("string")).otherwise(F.col("label_name"))).alias("name"), T.label_id(F.when(F.col("id") % 2 == 0, F.col("label_name")).otherwise(F.col("label").cast("string"))).alias("label_id")),
    "p16_prefixed_ids": lambda s, d: traffic(s, d).select("id", F.concat_ws(":", "source", F.col("position").cast("string")).alias("global_id"), F.concat_ws("#", F.col("id").cast("string"), F.col("position").cast("string")).alias("occurrence_id")),
    "p18_char_vocabulary": _vocabulary,
    "p18_char_ids": _encoded,
    "p19_word_ngrams": lambda s, d: canon(s, d).select(F.explode(T.word_ngrams(F.col("query_canonical"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")),
    **{f"p{20 + i:02d}_{n}": _one_feature(n) for i, n in enumerate(X.FEATURES)},
    "p32_feature_vector": lambda s, d: _features(s, d).drop("query_canonical"),
    "p32_documents": _documents_features,
    "p33_rounding": lambda s, d: _features(s, d).select("id", F.round(F.col("special_char_ratio") * 3, 6).alias("tripled")),
    "p34_log1p": lambda s, d: _features(s, d).select("id", F.round(F.log1p("length"), 6).alias("log_length"), F.round(F.log1p("max_digit_run"), 6).alias("log_digits")),
    "f1_content_filter": lambda s, d: C.content_filter(canon(s, d)).select("id", "is_attack"),
    "f2_without_labels": lambda s, d: C.without_labels(tagged(s, d), ["stacked", "time_blind"]).groupBy("label_name").agg(F.count("*").alias("n")),
    "f3_empty_http": lambda s, d: C.without_empty_http(traffic(s, d).withColumn("rest", T.without_wrapper(F.col("query_raw"))), "rest", ["src0", "src1"]).select("id", "rest"),
    "f4_move_callbacks": _move,
    "f6_leave_one_out": lambda s, d: tagged(s, d).filter("label <> 3").groupBy("label").agg(F.count("*").alias("n")),
}


def _w(body: str, ctes: str | None = None) -> str:
    return f"WITH {ctes or traffic_sql()} {body}"


def _c(body: str) -> str:
    return _w(body, steps_sql())


def _t(body: str, stream: bool = False) -> str:
    return _w(body, tagged_sql(stream))


FEATURE_SQL = {n: _c(Q.rstrip(", ") + f" SELECT id, {e} AS {n} FROM q") for n, e in PLAIN.items()}
FEATURE_SQL["entropy"] = _c(Q + ENTROPY + " SELECT q.id, coalesce(round(v, 6), 0.0) AS entropy FROM q LEFT JOIN en USING (id)")
FEATURE_SQL["bigram_entropy"] = _c(Q + BIGRAMS + " SELECT q.id, coalesce(round(v, 6), 0.0) AS bigram_entropy FROM q LEFT JOIN be USING (id)")
_ALL = ", ".join(f"{e} AS {n}" for n, e in PLAIN.items())
REST = r"trim(regexp_extract({}, '(?s)[\s?](.*)$', 1))"

SQL = {
    "flagship_windows": _t(Q.rstrip(", ") + ", " + ENTROPY + f""" SELECT position // 1000 AS "window", count(*) AS n, {', '.join(f"round(avg(CAST(label = {i} AS DOUBLE)), 6) AS share_{x}" for i, x in enumerate(T.LABELS) if i)},
round(avg({PLAIN['length']}), 6) AS length, round(avg({PLAIN['special_char_ratio']}), 6) AS special_char_ratio, round(avg(coalesce(round(v, 6), 0.0)), 6) AS entropy, round(avg({PLAIN['quote_imbalance']}), 6) AS quote_imbalance FROM tagged JOIN q USING (id) LEFT JOIN en USING (id) GROUP BY 1""", True),
    "s10_traffic": _w("SELECT id, client, position, source, is_attack, query_raw FROM traffic"),
    "p01_canonicalize": _c("SELECT id, query_canonical, has_comment_marker FROM canon"),
    "p02_url_decode": _c("SELECT id, d AS decoded FROM u"),
    "p03_hex_literals": _w(f"SELECT id, {_stitched('hp', 'hm', _HEX_ONE)} AS decoded FROM (SELECT id, string_split_regex(query_raw, '0x[0-9a-fA-F]{{2,}}') AS hp, regexp_extract_all(query_raw, '{HEX}', 1) AS hm FROM traffic)"),
    "p04_char_calls": _w(f"SELECT id, {_stitched('cp', 'cm', _CHAR_ONE)} AS decoded FROM (SELECT id, string_split_regex(query_raw, '{CHARS.replace('([0-9]', '(?:[0-9]')}') AS cp, regexp_extract_all(query_raw, '{CHARS}', 1) AS cm FROM traffic)"),
    "p05_comment_marker": _w(f"SELECT id, {COMMENT.format('query_raw')} AS has_comment_marker FROM traffic"),
    "p06_lower": _w("SELECT id, lower(query_raw) AS lowered FROM traffic"),
    "p07_clean": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))) AS md5 FROM documents",
    "p08_strip_wrapper": f"SELECT page_id, {REST.format('url')} AS rest FROM pages",
    "p09_attack_tag": _c(f"SELECT id, {tag_sql('query_canonical')} AS label FROM canon WHERE is_attack"),
    "p10_tag": _t("SELECT id, label, label_name FROM tagged"),
    "p11_any_signature": _c(f"SELECT id, {signature_sql('query_canonical')} AS matched FROM canon"),
    "p11_pages_signature": f"SELECT page_id, {signature_sql('html')} AS matched FROM pages",
    "p12_callback": _c(f"SELECT id, {CALLBACK} AS matched FROM canon"),
    "p13_template": _c("SELECT id, contains(query_canonical, '/blog/index.php/2020/03') AS matched FROM canon"),
    "p14_probe_target": _c(r"SELECT id, nullif(regexp_extract(query_canonical, 'username\s*=\s*''([^'']+)''', 1), '') AS target FROM canon"),
    "p15_label_names": _t("SELECT id, label_name AS name, label AS label_id FROM tagged"),
    "p16_prefixed_ids": _w("SELECT id, source || ':' || position AS global_id, id || '#' || position AS occurrence_id FROM traffic"),
    "p18_char_vocabulary": _c("SELECT ch, n, CAST(row_number() OVER (ORDER BY n DESC, ch) + 1 AS INTEGER) AS id FROM (SELECT unnest(string_split(query_canonical, '')) AS ch, count(*) AS n FROM canon GROUP BY 1 ORDER BY n DESC, ch LIMIT 40)"),
    "p18_char_ids": _c(", v AS (SELECT ch, row_number() OVER (ORDER BY n DESC, ch) + 1 AS vid FROM (SELECT unnest(string_split(query_canonical, '')) AS ch, count(*) AS n FROM canon GROUP BY 1 ORDER BY n DESC, ch LIMIT 40)), e AS (SELECT id, i, substr(query_canonical, i, 1) AS ch FROM canon, range(1, 33) r(i)) SELECT id, string_agg(CASE WHEN e.ch = '' THEN 0 ELSE coalesce(vid, 1) END, ',' ORDER BY i) AS ids FROM e LEFT JOIN v USING (ch) GROUP BY id".replace(", v AS", ", v AS", 1)),
    "p19_word_ngrams": _c(r", w AS (SELECT id, ' ' || unnest(regexp_extract_all(query_canonical, '\S+')) || ' ' AS t FROM canon), g AS (SELECT substr(t, i, n) AS gram FROM w, range(2, 5) a(n), range(1, 400) b(i) WHERE n <= length(t) AND i <= length(t) - n + 1) SELECT gram, count(*) AS n FROM g GROUP BY gram"),
    **{f"p{20 + i:02d}_{n}": FEATURE_SQL[n] for i, n in enumerate(X.FEATURES)},
    "p32_feature_vector": _c(Q + ENTROPY + ", " + BIGRAMS + f" SELECT q.id, {_ALL}, coalesce(round(en.v, 6), 0.0) AS entropy, coalesce(round(be.v, 6), 0.0) AS bigram_entropy FROM q LEFT JOIN en USING (id) LEFT JOIN be USING (id)"),
    "p32_documents": "WITH q AS (SELECT doc_id AS id, text AS t FROM documents), " + ENTROPY + ", " + BIGRAMS + f" SELECT q.id, {PLAIN['length']} AS length, {PLAIN['special_char_ratio']} AS special_char_ratio, coalesce(round(en.v, 6), 0.0) AS entropy, coalesce(round(be.v, 6), 0.0) AS bigram_entropy FROM q LEFT JOIN en USING (id) LEFT JOIN be USING (id)",
    "p33_rounding": _c(Q.rstrip(", ") + f" SELECT id, round({PLAIN['special_char_ratio']} * 3, 6) AS tripled FROM q"),
    "p34_log1p": _c(Q.rstrip(", ") + f" SELECT id, round(ln(1 + {PLAIN['length']}), 6) AS log_length, round(ln(1 + {PLAIN['max_digit_run']}), 6) AS log_digits FROM q"),
    "f1_content_filter": _c(f"SELECT id, is_attack FROM canon WHERE is_attack OR NOT {signature_sql('query_canonical')}"),
    "f2_without_labels": _t("SELECT label_name, count(*) AS n FROM tagged WHERE label_name NOT IN ('stacked', 'time_blind') GROUP BY 1"),
    "f3_empty_http": _w(f"SELECT * FROM (SELECT id, {REST.format('query_raw')} AS rest, source FROM traffic) WHERE NOT (source IN ('src0', 'src1') AND rest = '')").replace("SELECT * FROM (", "SELECT id, rest FROM ("),
    "f4_move_callbacks": _c(f"SELECT id, CASE WHEN NOT is_attack AND {CALLBACK} THEN 'ssrf_moved' ELSE source END AS source, CASE WHEN is_attack OR {CALLBACK} THEN 'anomalous' ELSE 'normal' END AS pool FROM canon"),
    "f6_leave_one_out": _t("SELECT label, count(*) AS n FROM tagged WHERE label <> 3 GROUP BY 1"),
}
