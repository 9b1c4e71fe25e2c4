"""Stages of the corpus pipeline, each against a plain version on its own input."""

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.test_text_ops import base, hits

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = P.by_language(spark, docs, DATA).cache()
    assert kept.columns == columns and kept.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    unique = P.near_duplicates(spark, kept, DATA).cache()
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == set(brute.classes(rows).values())
    clean = P.benchmark_free(spark, unique, DATA).cache()
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect() if not hits(r.text, items)[1]}
    safe = P.personal_data(spark, clean, DATA).cache()
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert base(r.text) == [] and (r.text == texts[r.doc_id]) <= (base(texts[r.doc_id]) == []) and r.n_chars == len(r.text)
    pieces = P.packed(spark, safe, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in safe.collect()}


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "The and of the thing and that", None, None, 29), (3, "The and of the thing and that", None, None, 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in P.STAGES:
            out = stage(spark, out, DATA)
        out.collect()


def test_columns_of_any_name(spark):
    """Columns named like those that the operators add, whatever their case, come through unchanged."""
    docs = spark.createDataFrame([(1, "The and of the thing and that", "en", "s", 29, "a", "b", "c", "d", 1)], "doc_id long, text string, lang string, source string, n_chars int, _language string, _Found string, _private string, class_id string, keep int")
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, DATA)
        assert out.columns == docs.columns and out.count() == 1
    assert out.drop("lang").first() == docs.drop("lang").first()
    assert P.packed(spark, out, DATA).count() == 1
