"""Operators on documents against plain versions, and odd rows."""

import json
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trafficwarden.llm import ann, chat, decontaminate, html_text, language, licenses, packing, pii, tokens

DATA = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", "b"), (3, "!!! ???", "c"), (4, "MIT License", "d"), (4, "MIT License", "d"), (None, "no id", "e"), (5, "x" * 300_000, "f"), (6, "word " * 60_000, "g"), (7, "naïve café 10.0.0.1 é", "h")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column named like those of the operators."""
    return spark.createDataFrame(ODD, "doc_id long, text string, row string").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


# Decontamination.


def hits(text, items, window=10):
    w, hit, found = brute.words(text), set(), set()
    for item, t in items:
        iw = brute.words(t)
        for p in [iw[i : i + window] for i in range(max(1, len(iw) - window + 1))] if iw else []:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, odd, block_bytes):
    items = [("1", "mit license"), ("2", None), ("3", "..."), ("4", "a b c d e f g h i j k l"), ("5", "word word word word word word word word word word word"), ("6", "naïve")]
    rows = [*ODD, (8, "x A b, C d e f g h i j. k z", "i"), (9, "b c d e f g h i j k l m", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = decontaminate.find_benchmark(df, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "row", "found"]
    seen = sorted((r.row, r.found.n_words, sum(h.last - h.first + 1 for h in r.found.hits), r.found["items"]) for r in got.collect())
    small = [x for x in seen if x[0] != "g"]
    assert small == sorted((k, *hits(t, items)) for _, t, k in rows if k != "g")
    assert [x for x in seen if x[0] == "g"] == [("g", 60_000, 60_000, ["5"])]
    empty = decontaminate.find_benchmark(df, spark.createDataFrame([], "item_id string, text string"))
    assert empty.filter(F.size("found.hits") > 0).count() == 0 and empty.count() == len(rows)
    assert decontaminate.find_benchmark(df.limit(0), spark.createDataFrame(items, "item_id string, text string")).count() == 0


@pytest.mark.parametrize("limit", [1, 20, 200])
def test_parts_of_an_item_keep_its_windows(limit):
    rng = np.random.default_rng(limit)
    for n in (0, 1, 9, 10, 11, 40, 300):
        words = ["w" * int(k) for k in rng.integers(1, 9, n)]
        parts = [p.split() for p in decontaminate.cut(", ".join(words).upper(), 10, limit)]
        at = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
        assert set().union(*map(at, parts)) == at(words) and all(len(p) >= min(10, n) for p in parts)
        assert all(len(" ".join(p)) <= limit + 9 or len(p) <= 10 for p in parts)


def test_blocks_are_bounded_whatever_the_ids(spark, odd):
    """Items of one id, of none, and one longer than a block: no block is large, and the hits are those of a single one."""
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abc"), 3))
    texts = [" ".join(word() for _ in range(14)) for _ in range(120)]
    items = [*[("same", t) for t in texts[:50]], *[(None, t) for t in texts[50:100]], *[(str(i), t) for i, t in enumerate(texts[100:])], ("long", " ".join(word() for _ in range(900))), ("none", None), ("none", "...")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    parts, blocks = decontaminate.dealt(benchmark.select(F.col("item_id").alias("item"), "text"), 10, 1000)
    sizes = [r.n for r in parts.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(sizes) == blocks >= 10 and max(sizes) <= 1500 + 40
    rows = [(i, f"x {items[i][1]} y {items[-3][1][40 * i : 40 * i + 90]}", "r") for i in range(0, 120, 17)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    plain = lambda b: sorted((r.doc_id, r.found.n_words, [tuple(h) for h in r.found.hits], r.found["items"]) for r in decontaminate.find_benchmark(df, benchmark, block_bytes=b).collect())
    whole = plain(1 << 20)
    assert whole == plain(3000) and all(h for _, _, h, _ in whole)


# Licences.


def test_licences(spark, odd):
    rows = [(10, "the MIT, license. Apache License", "k"), (11, "Licensed under the Apache License, Version 2.0.", "l"), (12, "GNU General Public License version 3", "m"), (13, "mit licensed", "n"), (14, "MİT License K", "o")]
    df = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    got = {r.row: [(p.label, p.start) for p in r.licenses.places] for r in licenses.scan(df).collect()}
    assert got["d"] == [("mit", 0)] and sorted(got["k"]) == [("apache", 3), ("mit", 1)]
    assert sorted(got["l"]) == [("apache", 3), ("apache-2.0", 3)] and sorted(got["m"]) == [("gpl", 1), ("gpl-3.0", 1)]
    assert all(got[k] == [] for k in "abcefghno")
    assert licenses.scan(df.limit(0)).count() == 0


def test_index_words_are_the_rarest_of_the_files(spark):
    """Counts are by file; the index follows them, and no choice of words changes the places."""
    texts = ["mit License, MIT license", "a license", "The license of mit", "Apache License", None, "", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby hereby hereby"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = licenses.frequencies(df)
    assert held["license"] == 4 and held["mit"] == 2 and held["apache"] == 1 and held["hereby"] == 2 and held["mozilla"] == 0
    chosen = {t["label"]: [w for _, w in e] for t, e in zip(licenses.parsed(), licenses.index(held))}
    assert chosen["mit"] == ["mit", "license"] and chosen["mpl-2.0"][0] == "mozilla" and "hereby" not in chosen["mit-grant"]
    places = lambda h: [(r.doc_id, sorted((p.label, p.start) for p in r.licenses.places)) for r in licenses.scan(df, held=h).orderBy("doc_id").collect()]
    rng = np.random.default_rng(0)
    first = places(None)
    assert first[0] == (0, [("mit", 0), ("mit", 2)]) and first[6] == (6, [("mit-grant", 0)])
    for _ in range(3):
        assert places({w: int(rng.integers(0, 9)) for w in held}) == first


# Packing.


def test_ids_are_those_of_the_other_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    other, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.default_ranks())
    texts = [r.text for r in docs.limit(60).collect()] + ["", " \n\n x  ", "a<|endoftext|>b", "日本語 😀", "don't we'LL", "\t é"]
    for t in texts:
        assert encode(t) == other.encode(t, add_special_tokens=False).ids


def test_packing_is_exact(docs, odd):
    encode = packing.encoder(packing.default_ranks())
    for df in (docs, odd.select("doc_id", "text", "row")):
        want = sorted(zlib.crc32(np.array(encode(r.text or "") + [0], "<u4").tobytes()) for r in df.collect())
        pieces = sorted(packing.pack(df).collect(), key=lambda p: (p.sequence_id, p.offset))
        fill, starts = {}, {}
        for p in pieces:
            assert fill.get(p.sequence_id, 0) == p.offset and 0 < p.length == len(p.ids) // 4
            fill[p.sequence_id] = p.offset + p.length
        assert sorted(fill) == list(range(len(fill))) and all(v == 1024 for k, v in fill.items() if k < len(fill) - 1)
        whole, done = [], b""
        for p in pieces:  # documents lie end to end along the curve
            assert p.start == len(done) // 4
            done += bytes(p.ids)
            if len(done) == 4 * p.doc_tokens:
                whole.append(zlib.crc32(done))
                done = b""
        assert sorted(whole) == want and starts == {}
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert_keys_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# Token counts.


def test_counts_follow_edits():
    split, encode = tokens.splitter(), packing.encoder(packing.default_ranks())
    random.seed(1)
    parts = ["a", "bc", " ", "  ", "\n", "'s", "'", "12", "é", "!", "?! ", " the", "\t"]
    for _ in range(400):
        t = "".join(random.choice(parts) for _ in range(random.choice([0, 1, 5, 40, 400])))
        tree = tokens.EditedCount(t, split, lambda p: len(encode(p)))
        for _ in range(4):
            a, n = random.randint(0, len(t) + 2), "".join(random.choice(parts) for _ in range(random.choice([0, 1, 10])))
            b = a + random.choice([0, 1, 3, 50])
            tree.apply(a, b, n)
            a, b = min(a, len(t)), min(b, len(t))
            t = t[:a] + n + t[b:]
            assert tree.text() == t and tree.total() == len(encode(t)) and [p for leaf in tree.leaves for p in leaf] == split(t)


def test_token_counts(spark, odd):
    encode = packing.encoder(packing.default_ranks())
    out = tokens.counted(odd, tokens.sample_edits(F.col("text"))).collect()
    assert len(out) == len(ODD) and all(r.tokens.tokens == len(encode(r.text or "")) for r in out)
    assert all(r.tokens.recounted < 60 for r in out)
    assert tokens.counted(odd.limit(0), F.lit(None).cast("array<struct<start:bigint,end:bigint,text:string>>")).count() == 0


# Language.


def test_language_held_out_accuracy(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    found = language.identify(docs, model).withColumn("held", language.held_out(F.col("doc_id"))).collect()
    held = [r for r in found if r.held]
    assert len(held) > 100 and np.mean([r.language.lang == r.lang for r in held]) > 0.97
    assert np.mean([r.language.rejected for r in found]) < 0.005
    out = {r.row: r.language for r in language.identify(odd, model).collect()}
    assert all(out[k].lang == "und" and out[k].rejected for k in "abc") and out["h"].lang != "und"
    noise = spark.createDataFrame([("qxzj wvkq zzxq jjvw " * 20,)], "text string")
    assert language.identify(noise, model).first().language.rejected
    assert language.identify(odd.limit(0), model).count() == 0
    none = language.fit(docs.limit(0))
    assert {r.language.lang for r in language.identify(odd, none).collect()} == {"und"}


def test_probabilities_sum_to_one():
    m = language.KneserNey({"a": ["abc abd abe " * 5] * 5, "b": ["xyz xyy " * 5] * 5})
    table, prob, *_ = m.levels[0]
    assert (2.0 ** prob.astype(float)).sum(1).max() <= 1.0001


def plain_kneser_ney(texts, text, order, letters):
    """Bits per symbol of text under interpolated Kneser-Ney of texts, from dictionaries; letters maps a letter to its symbol."""
    def sequence(t):
        out = [0]
        for c in t.lower():
            x = letters.get(c, 1) if c.isalpha() else 0
            out += [x] if x or out[-1] else []
        return out + [0] if out[-1] else out

    def places(seq):
        return [tuple(([0] * order + seq)[i + 1 : i + 1 + order]) for i in range(1, len(seq))]

    seen = Counter(g for t in texts for g in places(sequence(t)))
    counts = {order: seen}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # different symbols before it
    rules = {}
    for n, c in counts.items():
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        rules[n] = once / (once + 2 * twice) if once and twice else 0.5, total, kinds

    def p(g):
        if not g:
            return 1 / (len(letters) + 2)
        n, (discount, total, kinds) = len(g), rules[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        return (max(counts[n][g] - discount, 0) + discount * kinds[g[:-1]] * p(g[1:])) / total[g[:-1]]

    own = places(sequence(text))
    return -sum(np.log2(p(g)) for g in own) / max(len(own), 1)


def test_cross_entropy_is_that_of_a_plain_model():
    rng = random.Random(4)
    made = lambda signs, n: ["".join(rng.choice(signs) for _ in range(60)) for _ in range(n)]
    samples = {"a": made("abcde  .é", 4), "b": made("cdefg  1-", 4)}  # fewer than five texts: all are fitted
    m = language.KneserNey(samples)
    letters = {chr(c): i + 2 for i, c in enumerate(m.common)}
    texts = [*made("abcdefgh é.1", 6), "x", "aaaa", "", " ", "Abc  DE!"]
    bits, _, _ = m.cross_entropy(texts)
    for j, x in enumerate(m.langs):
        for i, t in enumerate(texts):
            assert abs(bits[i, j] - plain_kneser_ney(samples[x], t, m.order, letters)) < 1e-4


# Personal data.


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return pii.in_order(out)


def test_base_spans():
    random.seed(2)
    for _ in range(5000):
        t = "".join(random.choice("ab1 2.3@+-()5%.@.. 4é") for _ in range(50))
        assert pii.base_spans(t) == base(t)
    assert pii.base_spans("9" * 20_000 + "." + "0" * 9_000 + "1.2.3") == []


def test_personal_data(spark, odd, docs):
    model = pii.fit(docs)
    rows = pii.find_private(docs, model).collect()
    assert all([(s.start, s.end, s.kind) for s in r.private.base] == base(r.text) for r in rows)
    assert all(set(map(tuple, r.private.base)) <= set(map(tuple, r.private.spans)) for r in rows)
    plain = [r for r in rows if not re.search("[0-9@]", r.text)]
    assert plain and all(r.private.redacted == r.text for r in plain)
    found = {r.row: r.private for r in pii.find_private(odd, model).collect()}
    assert found["a"].redacted is None and found["b"].redacted == "" and found["h"].redacted == "naïve café [IP] é"
    texts = ["call (555) 010-2345 now", "card 4111 1111 1111 1112 typo", "on 2024-01-02 it cost 1234567 units"]
    spans = pii.model_spans(model, texts)
    assert [k for *_, k in spans[0]] == ["phone"] and [k for *_, k in spans[1]] == ["card"] and spans[2] == []
    assert pii.find_private(odd.limit(0), model).count() == 0


def test_gradients_of_the_tagger():
    from trafficwarden.llm import lstm

    rng = np.random.default_rng(3)
    p = lstm.new_params(4, rng)
    for name, shape in (("ahead_x", (pii.SYMBOLS, 16)), ("back_x", (pii.SYMBOLS, 16)), ("out_w", (8, pii.TAGS)), ("out_b", (pii.TAGS,)), ("move", (pii.TAGS, pii.TAGS))):
        p[name] = (rng.standard_normal(shape) * 0.3).astype(np.float32)
    x, y = rng.integers(0, pii.SYMBOLS, (12, 3)), rng.integers(0, pii.TAGS, (12, 3))
    _, grads = pii._loss(p, x, y)
    for name in p:
        i = tuple(n // 2 for n in p[name].shape) if not name.endswith("_x") else (int(x[0, 0]), 5)
        old, e = p[name][i], 1e-2
        p[name][i] = old + e
        up = pii._loss(p, x, y)[0]
        p[name][i] = old - e
        down = pii._loss(p, x, y)[0]
        p[name][i] = old
        assert abs((up - down) / (2 * e) - grads[name][i]) < 2e-2


def test_log_sums_and_best_path_are_those_of_all_taggings():
    from itertools import product

    rng = np.random.default_rng(5)
    for steps in (1, 2, 4):
        e, p = rng.normal(size=(steps, 3, pii.TAGS)) * 2, {"move": rng.normal(size=(pii.TAGS, pii.TAGS))}
        paths = np.array(list(product(range(pii.TAGS), repeat=steps)))
        a, b, whole = pii._sums(p, e)
        best = pii._viterbi(p, e)
        for i in range(3):
            score = e[np.arange(steps), i, paths].sum(1) + p["move"][paths[:, :-1], paths[:, 1:]].sum(1)
            weight = np.exp(score - score.max())
            assert abs(whole[i] - score.max() - np.log(weight.sum())) < 1e-6
            assert (paths[score.argmax()] == best[i]).all()
            for t in range(steps):
                share = np.bincount(paths[:, t], weight, pii.TAGS) / weight.sum()
                assert np.allclose(np.exp(a[t, i] + b[t, i] - whole[i]), share, atol=1e-6)


# Pages.


def test_blocks():
    page = '<p>a<b>b</b>c &amp; d<br>e<p>f<script>var t="</p>";</script><div hidden>g</div>x < y</p> <a title="a>b" href=q>link</a> tail <!-- c --> z<unclosed'
    assert [b.text for b in html_text.blocks(page)] == ["abc & d e", "f", "g", "x < y", "link tail z<unclosed"]
    assert html_text.blocks("") == [] and html_text.blocks("<" * 50_000)[0].text == "<" * 50_000


class PlainText(HTMLParser):
    """Text of a piece of a page, by the parser of the standard library: a space at every tag that isn't within a line."""

    WITHIN = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark math mi mn mo mrow object q s samp small span strike strong sub sup time tt u var".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.skipped = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style", "noscript", "template")
        self.parts += [] if tag in self.WITHIN else [" "]

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style", "noscript", "template")
        self.parts += [] if tag in self.WITHIN else [" "]

    def handle_data(self, data):
        self.parts += [] if self.skipped else [data]

    def text(self):
        return " ".join("".join(self.parts).split())


@pytest.mark.parametrize(("page", "want"), [
    ("<p>Let <math><mi>x</mi><mo>+</mo><mi>y</mi></math> be <object><p>fallback</p></object><xmp>a <b> &amp;</xmp> end", "Let x+y be fallback a <b> &amp; end"),
    ("<p>one</p><svg><path d='M0'/><p>two</p><p>three</p>", "one two three"),
    ("<p>one <svg viewBox='0 0'><title>Icon</title><text>A</text><text>B</text></svg> two</p>", "one A B two"),
    ("<p>one <math><mi>x</p><p>two</p>", "one x two"),
    ("<div><p>one <svg><g></div><div>two</div>", "one two"),
    ("<p>one<noscript>off</noscript><template><p>never</p></template> two<svg/> three</p>", "one two three"),
    ("<p>one<noscript>open <p>two", "one open two"),
    ("<p>one<script>if (a < b) '</p>'</script> two<style>p {}</style></p><iframe src=x>never</iframe>three", "one two three"),
    ("<p>one</p><script>never closed <p>two</p>", "one"),
])
def test_only_what_never_shows_is_left_out(page, want):
    assert " ".join(b.text for b in html_text.blocks(page)) == want


def test_main_text(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    model = html_text.fit(pages)
    for r in html_text.extract(pages, model).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert r.main_text == PlainText(article).text()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<html><body><nav><a href=x>menu</a></nav></body></html>")], "page_id long, html string")
    assert [r.main_text for r in html_text.extract(odd, model).orderBy("page_id").collect()] == ["", "", ""]
    assert html_text.extract(odd.limit(0), model).count() == 0
    made = html_text.made_pages(150, ["alpha", "beta"], seed=77)
    scores = html_text.main_scores(model, [b for b, _ in made], {})
    assert np.mean(np.concatenate([(s >= 0.5) == np.array(y) for (_, y), s in zip(made, scores)])) > 0.98


# Neighbours.


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[100:1100] = x[5]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [1.0, None] + [1.0] * 22), (None, [1.0] * 24), (5004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s.round(12)))[:20]
        assert [k for k, *_ in found] == list(range(1, 21)) and np.allclose([v for *_, v in found], [x[q] @ x[i] for _, i, _ in found])
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0
    again = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.9, 0.0]), (2, [0.5, 0.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(again, F.lit(True)).filter("query_id = 0").collect())
    want = [(0, 1, 0, 1.0), (0, 2, 0, 0.9), (0, 3, 2, 0.5)] * 2 + [(0, 1, 0, 0.9), (0, 2, 0, 0.9), (0, 3, 2, 0.45)]
    assert got == sorted(want)  # rows of equal ids are rows of their own; other lengths are apart


def test_recall_against_sql(spark):
    import duckdb

    con, data = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = {(q, v): s for q, _, v, s in con.execute(ann.EXACT_SQL).fetchall()}
    got = ann.op2_nearest(spark, data).collect()
    assert len(got) == len(want) and len({(r.query_id, r["rank"]) for r in got}) == len(got)
    assert sum((r.query_id, r.vec_id) in want for r in got) >= 0.9 * len(want)
    assert all(abs(want[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in want)


def test_neighbours_of_clusters_and_outliers(spark):
    """Every query gets its 20 rows, though most of the neighbours lie in a single list and some lists hold a vector or two."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([np.repeat(centres, 50, axis=0) + rng.normal(size=(3000, 16)) * 0.01, rng.normal(size=(60, 16)) * 1.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.lit(True)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(got) == list(range(len(x))) and {len(v) for v in got.values()} == {20}
    best = np.argsort(-(x @ x.T - np.diag(np.full(len(x), np.inf))), axis=1)[:, :20]
    recall = np.array([len(got[i] & set(best[i])) / 20 for i in range(len(x))])
    assert recall.mean() > 0.9 and recall[3000:].mean() > 0.8


# Preferences.


def test_preferences(spark):
    kind = "conv_id long, turn int, role string, text string, extra string"
    one = spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", "same", ""), (3, 0, "user", None, ""), (3, 0, "user", None, ""), (None, 0, "user", "x", "")], kind)
    two = spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "bad", ""), (2, 0, "user", "same", ""), (3, 0, "user", None, ""), (4, 0, "user", "z", "")], kind)
    got = {(r.conv_id, r.part, r.text, r.learned_from, r.learned_to) for r in chat.format_preferences(one, two).collect()}
    assert got == {(1, "prompt", "<|user|>\nq<|end|>\n", 0, 0), (1, "chosen", "<|assistant|>\ngood<|end|>\n", 14, 26), (1, "rejected", "<|assistant|>\nbad<|end|>\n", 14, 25), (2, "prompt", "<|user|>\nsame<|end|>\n", 0, 0), (3, "prompt", "<|user|>\n<|end|>\n", 0, 0), (3, "chosen", "<|user|>\n<|end|>\n", 0, 0)}
    assert chat.format_preferences(one.limit(0), two).count() == 0
    assert json.dumps(sorted(chat.swapped_answers(one).columns)) == '["conv_id", "role", "text", "turn"]'


def test_every_answered_conversation_gets_a_pair(spark):
    """With gaps in the ids, conversations without an answer, and for the last one."""
    turns = spark.createDataFrame([(c, t, r, f"{r}{c}") for c in (3, 40, 41, 90, 700) for t, r in enumerate(["user", "assistant"]) if (c, r) != (41, "assistant")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r.text for r in chat.swapped_answers_all(turns).filter("role = 'assistant'").collect()}
    assert got == {3: "assistant40", 40: "assistant90", 90: "assistant700", 700: "assistant3"}
    assert chat.swapped_answers_all(turns.limit(0)).count() == 0


def test_preferences_of_all_match_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    got, want = chat.op7_preferences(spark, d).toPandas(), duck.execute(chat.OP7_SQL).df()
    order = ["conv_id", "part", "turn", "role", "copy", "text_md5"]
    assert got[want.columns].sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
    answered = duck.execute("SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL").fetchone()[0]
    assert got["conv_id"].nunique() == answered


def test_large_benchmark_still_jumps():
    """At the size of a whole block most shifts stay near their maximum."""
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 10))) for _ in range(30_000)]
    items = [(str(i), " ".join(words[j] for j in rng.integers(0, len(words), 200))) for i in range(2900)]
    assert sum(len(t) for _, t in items) > 3.5 * (1 << 20)
    strings = decontaminate.test_strings(items)
    tables = decontaminate.searchers(strings)[0]
    assert tables.jump.mean() > 0.5 * (tables.least - tables.block + 1)
    text = f"x {items[7][1]} y"
    assert decontaminate._scan(strings, pa.array([text]), [tables])[0] == {"n_words": 202, "hits": [{"first": 1, "last": 200}], "items": ["7"]}


def test_items_without_an_id(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), ("x", "a b"), (None, "b c")], "item_id string, text string")
    for size in (1 << 20, 3):
        found = decontaminate.find_benchmark(df, items, block_bytes=size).first().found
        assert [tuple(h) for h in found.hits] == [(0, 2)] and found["items"] == ["x"]
    with pytest.raises(ValueError):
        decontaminate.find_benchmark(df.withColumn("Found", F.lit(1)), items)


def test_huge_pages_are_bounded():
    """A page of 100,000 blocks among small ones, and 20,000 nested elements that nothing closes."""
    import resource

    small = [html_text.blocks(f"<p>a{i}</p>") for i in range(200)]
    model = html_text.train(html_text.made_pages(20, []), epochs=1)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    many = html_text.blocks("<p>word</p>" * 100_000)
    assert len(many) == 100_000
    scores = html_text.main_scores(model, [*small, many], {})
    assert len(scores[-1]) == 100_000 and all(len(s) == 1 for s in scores[:-1])
    deep = html_text.blocks("".join(f"<div class='c{i % 300}'>t" for i in range(20_000)) + "</x>" * 20_000)
    assert len(deep) == 20_000 and len(html_text.main_scores(model, [deep], {})[0]) == 20_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_queries_match_sql(spark):
    """The registered queries of licences and decontamination give the rows of their SQL."""
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for query, sql in ((licenses.op1_licenses, licenses.OP1_SQL), (decontaminate.op9_decontamination, decontaminate.OP9_SQL)):
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, query(spark, d).select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_spans_longer_than_a_window_are_rejoined():
    parts = [(10, 128, "email", 0.9, False, True), (64, 192, "email", 0.8, True, True), (128, 200, "email", 0.9, True, False), (400, 512, "ip", 0.9, False, True)]
    assert [(a, b, k) for a, b, k, _ in pii._rejoined(parts)] == [(10, 200, "email")]
