import numpy as np
import pyarrow as pa

from tests.llm import brute
from trafficwarden.llm import neardup as N


def test_classes_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == brute.classes([(r.doc_id, r.text) for r in docs.collect()])


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    seen, true = [], []
    for _ in range(60):
        common = rng.integers(0, 2**62, 150, dtype=np.uint64)
        a, b = np.repeat(common, rng.integers(1, 9, 150)), np.repeat(common, rng.integers(1, 9, 150))
        row, hashes, weights = N.bag(np.concatenate([a, b]), np.array([len(a), len(b)]))
        s = N.signatures(row, hashes, weights, 2)
        seen.append((s[0] == s[1]).mean())
        true.append(N.overlap(a, b))
    assert abs(np.mean(seen) - np.mean(true)) < 0.02


def test_groups_of_half_similar_texts_in_chunks(spark, monkeypatch):
    """Many texts share most of a passage but only some pairs are near: every link is found."""
    monkeypatch.setattr(N, "CHUNK", 9)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, 120, 3 if i % 3 else 1):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.classes(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!!", "c"), (4, "!!!", "d"), (5, "one two", "e"), (6, "ONE, two", "f"), (7, "one two three", "g"), (7, "one two three", "h"), (8, "long " * 300_000, "i"), (9, "long " * 299_999, "j"), (None, "no id here at all", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = N.near_duplicates(docs)
    assert out.columns == ["doc_id", "text", "digest", "class_id", "keep"]
    got = sorted((r.digest, r.class_id, r.keep) for r in out.collect())
    assert got == [("a", 1, True), ("b", 1, False), ("c", 3, True), ("d", 3, False), ("e", 5, True), ("f", 5, False), ("g", 7, True), ("h", 7, False), ("i", 8, True), ("j", 8, False), ("k", None, True)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_run_hashes_are_of_the_words():
    hashes, counts, *_ = N.run_hashes(pa.array(["a b c d e f", "A, b c d e; f", None, "b c d e f"]))
    assert counts.tolist() == [2, 2, 0, 1]
    assert hashes[:2].tolist() == hashes[2:4].tolist() and hashes[4] == hashes[1]


def _written(monkeypatch):
    """Names of the tables that are written, and the lines of their plans."""
    found, write = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, tag: (found.append((tag, df._jdf.queryExecution().optimizedPlan().toString().count("\n"))), write(df, tag))[1])
    return found


def test_components_of_chains_stars_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 6)
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 530)] + [(700 + i, 699) for i in range(20)] + [(5, 5), (9, 8), (8, 9)]
    links += [tuple(int(x) for x in rng.integers(1000, 1060, 2)) for _ in range(50)]
    head = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(len(head)):
        for a, b in links:
            if a != b:
                head[a] = head[b] = min(head[a], head[b])
    got = [tuple(r) for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted(head.items())
    assert N.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_stars_need_no_step_and_plans_stay_small(spark, monkeypatch):
    """Each plan and task leaves its trace on the driver: stars are known at once, a table without frequent keys is joined once."""
    found = _written(monkeypatch)
    got = {r.uid: r.comp for r in N.components(spark.createDataFrame([(2, 1), (3, 1), (9, 7)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7} and [t for t, _ in found] == ["edges", "nodes"]
    found.clear()
    assert N.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")).filter("comp = 0").count() == 31
    assert max(n for _, n in found) <= 12
