"""SentencePiece, fill-in-middle and clustering against plain versions, and odd rows."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import DATA, ODD
from trafficwarden.llm import decontaminate, fim, html_text, kmeans, language, licenses, neardup, pii, sentences, tokens


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, row string").cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("scan", ["licenses", "tokens", "html", "language", "private", "neardup", "pieces", "fim"])
def test_clashing_names_raise(spark, scan):
    df = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, html string, FOUND string")
    call = {
        "licenses": lambda: licenses.scan(df, found="found"),
        "tokens": lambda: tokens.counted(df, F.lit(None), found="found"),
        "html": lambda: html_text.extract(df, None, found="found"),
        "language": lambda: language.identify(df, None, found="found"),
        "private": lambda: pii.find_private(df, None, found="found"),
        "neardup": lambda: neardup.near_duplicates(df, class_id="found"),
        "pieces": lambda: sentences.encoded(df, found="found"),
        "fim": lambda: fim.transformed(df, found="found"),
    }[scan]
    with pytest.raises(ValueError, match="names to be added"):
        call()


# SentencePiece.


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentences.default_model())


@pytest.fixture(scope="module")
def encoder():
    return sentences.Encoder(sentences.model(sentences.default_model()))


def test_ids_and_texts_are_those_of_the_library(spark, library):
    rows = sentences.encoded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("text", "pieces.ids", F.col("pieces.text").alias("again")).collect()
    want = library.encode([r.text or "" for r in rows], add_eos=True)
    assert [list(r.ids) for r in rows] == want and [r.again for r in rows] == library.decode(want)


def test_random_texts(encoder, library):
    random.seed(2)
    tokens_, odd_parts = list(encoder.model.ids), [" ", "  ", "\n", "\t", "▁", "é", "́", "日", "😀", "ￃ", "\x00", "1", "<s>", '"', "ing", "th", "e"]
    for _ in range(4000):
        text = "".join(random.choice(tokens_) if random.random() < 0.5 else random.choice(odd_parts) for _ in range(random.choice([1, 2, 4, 9, 30])))
        ids = library.encode(text)
        assert encoder.ids(text) == ids and encoder.text(ids) == library.decode(ids)
    for _ in range(4000):  # ids that no text gives
        ids = [random.choice([0, 1, 2, random.randrange(3, 259), 28705, random.randrange(32000)]) for _ in range(random.randrange(7))]
        assert encoder.text(ids) == library.decode(ids)


def test_last_tokens_are_those_of_plain_merging(encoder):
    """The table's last token of every prefix is the last symbol that merging the prefix leaves."""
    random.seed(3)
    for _ in range(300):
        part = "▁" + "".join(random.choice("abeinorst") for _ in range(random.randrange(1, 14)))
        last = encoder.prefix_table(part)
        assert all(last[i] == sentences.merged(list(part[:i]), encoder.model.rank)[-1] for i in range(1, len(part) + 1))


def test_parts_are_never_reached_across():
    assert re.findall(sentences.part_pattern(["ab", "▁a", "..", "▁▁"]), "▁▁ab..▁b\nxa") == ["▁▁ab", "..", "▁b", "\n", "x", "a"]
    assert re.findall(sentences.part_pattern(["a.", "▁a"]), "▁a.▁▁\n") == ["▁a.", "▁▁", "\n"]
    assert re.findall(sentences.part_pattern(["a▁b"]), "▁a▁b\nb") == ["▁a▁b", "\n", "b"]
    assert re.findall(sentences.part_pattern([]), "▁ab") == ["▁", "a", "b"]


def test_sentencepiece_of_odd_rows(spark, odd, library):
    got = sentences.encoded(odd).collect()
    assert sorted((r.row, list(r.pieces.ids), r.pieces.text) for r in got) == sorted((k, library.encode(t or "", add_eos=True), library.decode(library.encode(t or "", add_eos=True))) for _, t, k in ODD)
    assert sentences.encoded(odd.limit(0)).count() == 0
    df = spark.createDataFrame([([1, 523, 28713, 2],), (None,), ([],)], "ids array<int>")
    assert [r.t for r in df.select(sentences.decoded(spark, F.col("ids")).alias("t")).collect()] == [library.decode([1, 523, 28713, 2]), None, ""]


# Fill-in-middle.


def plain_fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n, h = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fim_equals_plain_version(spark, odd):
    random.seed(4)
    parts = ["a", " ", "\n", "\t\x0b", "\x1c", "\x85", "é", "😀", " word", "<", "<P", "S>", "  "]
    made = [(i, "".join(random.choice(parts) for _ in range(random.randrange(60))), "m") for i in range(400)] + [(500, "a <P> b", "m"), (501, "x" * 70_000 + " y" * 70_000, "m")]
    df = odd.unionByName(spark.createDataFrame(made, odd.schema))
    got = fim.transformed(df).select("doc_id", "text", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("again")).collect()
    assert len(got) == df.count() and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text) and r.again == (r.text or "")
    assert fim.transformed(odd.limit(0)).count() == 0


def test_boundary_set_selects_in_all_containers():
    rng = np.random.default_rng(5)
    array, bitmap = np.sort(rng.choice(65536, 900, replace=False)), np.sort(rng.choice(65536, 30_000, replace=False))
    runs = np.concatenate([np.arange(5, 4000), np.arange(9000, 65536)])
    offsets = np.concatenate([array, bitmap + 65536, runs + 3 * 65536, [9 * 65536 + 7]])
    made = fim.BoundarySet(offsets)
    assert made.kinds() == ["array", "bitmap", "runs", "array"] and len(made) == len(offsets)
    assert all(made.select(k) == offsets[k] for k in [*range(0, len(offsets), 7), len(offsets) - 1])
    with pytest.raises(IndexError):
        made.select(len(offsets))
    assert len(fim.BoundarySet(np.empty(0, np.int64))) == 0
    data = np.frombuffer(("é" * 70_000).encode(), np.uint8)
    (characters,) = fim.boundaries(data, np.array([0, len(data)]), "character")
    assert characters.kinds() == ["runs", "runs"] and characters.select(69_999) == 70_000


def test_ambiguous_markers_raise(odd):
    for markers in (("<P>", "<P>x", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "z")):
        with pytest.raises(ValueError, match="overlap"):
            fim.transformed(odd, markers=markers)


# Clustering.


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string")


def test_clusters_equal_sql_on_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = [(i, v.astype(np.float32).tolist(), "x") for i, v in enumerate(rng.normal(size=(150, 64)) * rng.uniform(0.01, 9, 64))]
    odd = [(200, None, "x"), (201, [1.0] * 63, "x"), (202, [None] + [1.0] * 63, "x"), (203, [float("nan")] * 64, "x"), (204, [float("inf")] * 64, "x"), (None, [0.5] * 64, "x"), (205, [0.0] * 64, None), (206, [-0.001] * 64, "x"), (7, base[8][1], "x")]
    df = vectors(spark, base + base[:30] + base[:1] * 40 + odd)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = kmeans.op13_clusters(spark, str(tmp_path)).toPandas()
    assert len(got) == 150 + 30 + 40 + 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(kmeans.OP13_SQL).df()
    order = sorted(got.columns)
    text = lambda d: sorted(tuple("null" if pd.isna(v) else str(int(v)) if c != "centroid_sha256" else v for c, v in zip(order, row)) for row in d[order].itertuples(index=False))
    assert text(got) == text(want)


def test_clusters_of_few_and_no_vectors(spark):
    few = kmeans.clustered(vectors(spark, [(1, [0.5] * 64, "a"), (2, [-0.5] * 64, "a"), (2, [-0.5] * 64, "a")])).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in few) == [(1, 0, 0), (2, 0, 0), (2, 0, 0)] and few[0].cluster in (0, 1, 2)
    assert kmeans.clustered(vectors(spark, [])).count() == 0 and kmeans.clustered(vectors(spark, [(1, None, "a")])).count() == 0
    with pytest.raises(Exception, match="too large"):
        kmeans.clustered(vectors(spark, [(1, [1e9] * 64, "a")], "double")).collect()


def test_filter_passes_by_centroids_without_loss():
    rng = np.random.default_rng(7)
    centres = rng.integers(-400, 400, (40, 64))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 64))
    mean = x.mean(0)
    turned = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :24]
    state = kmeans.Rotated(centres, mean, np.ascontiguousarray(turned))
    lead, rest, _ = state.project(x)
    best, distance, compared = state.nearest(x, lead.astype(np.float32).astype(float), rest.astype(np.float32).astype(float))
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all() and compared < 0.1 * every.size


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for f in ("documents", "embeddings"):
        path = f"{DATA}/{f}.parquet"
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{path + ('/*' if os.path.isdir(path) else '')}'")
    for query, sql in ((fim.op12_fim, fim.OP12_SQL), (kmeans.op13_clusters, kmeans.OP13_SQL)):
        got, want = query(spark, DATA).toPandas(), con.execute(sql).df()
        order = sorted(got.columns)
        text = lambda d: sorted(tuple("null" if pd.isna(v) else v if isinstance(v, str) else str(int(v)) for v in row) for row in d[order].itertuples(index=False))
        assert sorted(want.columns) == order and text(got) == text(want)
