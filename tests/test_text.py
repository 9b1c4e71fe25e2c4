"""Text functions and features on single strings."""

import pytest
from pyspark.sql import functions as F

from trafficwarden.functions import features as X
from trafficwarden.functions import text as T
from trafficwarden.operators import curate as C


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(("raw", "want"), [
    ("id=1%27", "id=1'"), ("1%2520OR", "1 or"), ("a+b", "a b"), ("0x61646d696e", "'admin'"), ("0xABC", "0xabc"), ("0x0001", "0x0001"), ("CHAR(65, 66,67)", "'abc'"), ("VARCHAR(255)", "var'ÿ'"), ("CHAR(99999999)", "char(99999999)"),
    ("LIKE '%zz'", "like '%zz'"), ("%ad%ff", "��"), ("CHAR(8364)", "'€'"), ("SELECT /* x */ 1 -- y", "select /* x */ 1 -- y"), ("", ""),
])
def test_canonical(spark, raw, want):
    assert one(spark, T.canonical, raw) == want


def test_null_text_stays_null(spark):
    row = X.with_features(T.canonicalize(spark.createDataFrame([(None,)], "query_raw string"))).first()
    assert row.query_canonical is None and row.entropy is None and row.length is None


@pytest.mark.parametrize(("text", "want"), [("/* a\nb */ 1", 1), ("admin'--", 1), ("plain - text", 0)])
def test_comment_marker(spark, text, want):
    assert one(spark, T.comment_marker, text) == want


@pytest.mark.parametrize(("text", "label"), [("1; DROP TABLE t", 5), ("'; DROP TABLE t; -- SLEEP(5)", 5), ("1 and sleep(5)", 4), ("waitfor delay '0:0:5'", 4), ("extractvalue(1,2)", 2), ("cast((select 1) as int)", 2), ("1 union all select null", 1), ("1 or 1=1", 3), ("x' or '1'='1", 3), ("odd", 3)])
def test_tags(spark, text, label):
    assert one(spark, T.attack_tag, text) == label


@pytest.mark.parametrize(("text", "want"), [(";cat /etc/passwd ", True), ("() { :;}; x", True), ("<!--#exec cmd=x-->", True), ("<script>x</script>", True), ("select name from users where id=1", False), ("cat food; cats", False)])
def test_signatures(spark, text, want):
    assert one(spark, T.any_signature, text) is want


@pytest.mark.parametrize(("text", "want"), [("http://a/b?x=1 y", "x=1 y"), ("/static/logo.png", ""), ("/p q=1", "q=1"), ("?a", "a")])
def test_wrapper(spark, text, want):
    assert one(spark, T.without_wrapper, text) == want


def test_features_of_small_texts(spark):
    row = X.with_features(spark.createDataFrame([("a'b\"(1 22 ;;;",)], "query_canonical string")).first()
    assert (row.length, row.sql_keyword_count, row.quote_imbalance, row.paren_imbalance, row.max_token_length, row.token_count, row.max_special_run, row.max_digit_run) == (13, 0, 2.0, 1.0, 6, 3, 3, 2)
    empty = X.with_features(spark.createDataFrame([("",)], "query_canonical string")).first()
    assert all(empty[f] == 0 for f in X.FEATURES)
    assert one(spark, X.entropy, "aabb") == 1.0 and one(spark, X.bigram_entropy, "aaaa") == 0.0
    assert round(one(spark, X.same_type_run_ratio, "ab12'é x"), 3) == 0.429


def test_ngrams_of_short_words(spark):
    assert one(spark, T.word_ngrams, "a bc") == [" a", "a ", " a ", " b", "bc", "c ", " bc", "bc ", " bc "]


def test_fragments_are_the_tokens(spark):
    text = "1 union select a, b from t where x=(1)"
    parts = one(spark, lambda c: T.fragments(c, 4, 1), text)
    assert 1 < len(parts) <= 4 and "".join(parts).replace(" ", "") == text.replace(" ", "")


def test_made_payloads_are_stacked(spark):
    rows = C.stacked_payloads(spark).withColumn("label", T.attack_tag(F.col("payload"))).collect()
    assert len({r.payload for r in rows}) == 363 and {r.label for r in rows} == {5}


def test_sql_functions(spark):
    T.create_sql_functions(spark)
    row = spark.sql("SELECT tw_comment_marker('a -- b') AS a, tw_is_callback('x OWASP.org') AS b, tw_clean(' a  b ') AS c, tw_probe_target(\"username = 'bob'\") AS d").first()
    assert tuple(row) == (1, True, "a b", "bob")


def test_same_rows_whatever_the_partitions(spark):
    rows = spark.range(500).selectExpr("id", "id % 3 AS label")
    a, b = (sorted(r.id for r in C.undersample(rows.repartition(n), "label", 20, "id").collect()) for n in (1, 7))
    assert a == b and len(a) == 60
