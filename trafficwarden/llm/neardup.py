"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A document is the bag of its runs of five lower-cased words (fewer words: one run; the word rule is
that of the other text operators). Two documents are linked when the bags' weighted Jaccard
similarity, sum of minima over sum of maxima, is at least the threshold; classes are the connected
components of the links.

Copies (equal words) are collapsed first, by a digest, with map-side combination. Each remaining
text gets a BagMinHash signature (Ertl 2018): the weights of a run are cut into the dyadic intervals
[0,1), [1,2), [2,4), ...; every interval holds a Poisson process whose points carry a time and a
signature slot, points above the weight are thinned away, and a slot keeps its earliest time. Runs of
``ROWS`` slots are hashed to bucket keys.

In each bucket all members are paired with the smallest member only, and the pairs are verified on
the whole texts. Buckets whose members then lie in several components (``mixed``) are looked at
again: buckets that share members form a group, a group is cut into chunks of bounded size, and every
pair of chunks is one task's block, in which all pairs of different components are verified at once
by a product of 0-1 matrices. Only the links that join components leave a block. So no bucket is cut,
no link is dropped, no pairs are shuffled, and a text is sent once for each chunk of its group, not
once for each pair or band. Components come from alternating star contractions over tables in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent, materialise, slices, spaced_words, text_bytes

WORDS, THRESHOLD = 5, 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 26 = 3e-5.
BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
#: Texts and word runs of a chunk of a group (about), and columns of the matrices at once.
CHUNK, CHUNK_RUNS, COLUMNS = 512, 1_000_000, 2048
#: A key with more than this part of the rows, and so many at least, is joined by a broadcast.
HOT = 1000
#: Size of the set of rows whose texts are compared.
FILTER_BITS = 1 << 24
#: Points of a process that are drawn at once after the first.
DRAWN = 8

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = np.full(size, _BASE), np.full(size, _BACK)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead), np.cumprod(back)


def run_hashes(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word runs of the rows end to end and how many each row has; the words' bytes, starts of the rows there."""
    data, starts = spaced_words(*text_bytes(column))
    gaps = np.flatnonzero(data == 32)
    first = np.searchsorted(gaps, starts)
    n = np.diff(np.append(first, len(gaps))) - 1
    counts = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    size = 1 << max(16, int(len(data)).bit_length())
    ahead, back = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * ahead[: len(data)], out=sums[1:])
    row = np.repeat(np.arange(len(n)), counts)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, end = gaps[at], gaps[at + np.minimum(words, n[row])]
    return mixed((sums[end] - sums[begin]) * back[begin]), counts, data, starts


def bag(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs and their weights; of the hashes 44 bits count, rows are fewer than 2**20."""
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    both = np.sort((row << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    both = both[at]
    return (both >> np.uint64(44)).astype(np.int64), mixed(both << np.uint64(20)), np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures: the earliest time of each slot, infinite for rows without runs."""
    owner, seed, low, size, weight = [row], [hashes], [np.zeros(len(row))], [np.ones(len(row))], [weights]
    left = 1
    on = weights > left
    while on.any():  # dyadic intervals [left, 2 * left) of the heavier runs
        owner.append(row[on])
        seed.append(mixed(hashes[on] + np.uint64(left)))
        low.append(np.full(on.sum(), float(left)))
        size.append(np.full(on.sum(), float(left)))
        weight.append(weights[on])
        left *= 2
        on = weights > left
    owner, seed, low, size, weight = map(np.concatenate, (owner, seed, low, size, weight))
    out = np.full(rows * slots, np.inf)
    time, drawn = np.zeros(len(owner)), np.zeros(len(owner), np.uint64)
    step = 1
    while len(owner):
        nth = drawn[:, None] + np.arange(1, step + 1, dtype=np.uint64)
        x = mixed(seed[:, None] + nth * _GOLD)
        gap = -np.log(((x >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / size[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        place = owner[:, None] * slots + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        wide = size > 1
        if wide.any():  # thinned by where in the interval the point lies
            u = (mixed(x[wide] ^ _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            keep = low[wide, None] + np.floor(u * size[wide, None]) < weight[wide, None]
            np.minimum.at(out, place[~wide].ravel(), times[~wide].ravel())
            np.minimum.at(out, place[wide][keep], times[wide][keep])
        else:
            np.minimum.at(out, place.ravel(), times.ravel())
        time, drawn = times[:, -1], drawn + np.uint64(step)
        last = out.reshape(rows, slots).max(axis=1)
        on = time < last[owner]
        owner, seed, low, size, weight, time, drawn = (v[on] for v in (owner, seed, low, size, weight, time, drawn))
        step = DRAWN
    return out.reshape(rows, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each row; the band's number is part of it."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mixed(key ^ bits[:, :, i]) + _GOLD
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            hashes, counts, data, starts = run_hashes(part.column(1))
            row, distinct, weights = bag(hashes, counts)
            keys = band_keys(signatures(row, distinct, weights, part.num_rows))
            raw, ends = data.tobytes(), np.append(starts, len(data)).tolist()
            texts = part.column(1)
            digest = [blake2b(raw[ends[i] : ends[i + 1]] if c else (b"\xff" + (texts[i].as_py() or "").encode()), digest_size=16).digest() for i, c in enumerate(counts.tolist())]
            some = counts > 0
            ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(keys[some]).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(counts, pa.int64()), bands], ["row", "text", "digest", "n", "bands"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of hashes."""
    if not len(a) or not len(b):
        return 0.0
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                one, n1, *_ = run_hashes(part.column(2))
                two, n2, *_ = run_hashes(part.column(3))
                e1, e2 = np.cumsum(n1), np.cumsum(n2)
                keep = [overlap(one[a - m : a], two[b - n : b]) >= threshold for a, m, b, n in zip(e1, n1, e2, n2)]
                kept = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(kept), part.column(1).filter(kept)], ["a", "b"])

    return run


def _involved(pairs: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """Rows of texts whose uid may be in pairs, written out.

    A bit set of fixed size (``FILTER_BITS``) says which, so that the texts of all others are not
    shuffled; where it fills up, more rows pass, none is lost.
    """
    slot = F.pmod(F.xxhash64("uid"), F.lit(FILTER_BITS))
    ids = pairs.select(F.col("a").alias("uid")).unionAll(pairs.select(F.col("b").alias("uid")))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # FILTER_BITS / 64 rows at most
        bits[r.word] = r.bits
    shared = pairs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["uid", "text"])

    return materialise(texts.select("uid", "text", slot.alias("slot")).mapInArrow(run, "uid long, text string"), tag)


def _links(pairs: DataFrame, texts: DataFrame, threshold: float, tag: str) -> DataFrame:
    """The pairs (a, b) whose whole texts are as similar as that, written out."""
    texts = _involved(pairs, texts, f"{tag}-texts")
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("one"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("two"))
    both = left.join(pairs, "a").join(right, "b").select("a", "b", "one", "two")
    return materialise(both.mapInArrow(_verified(threshold), "a long, b long"), tag)


def joined(rows: DataFrame, small: DataFrame, key: str, size: str, total: int, most: int | None = None) -> DataFrame:
    """rows joined with small, which has a row for each key and in ``size`` how many rows have it (dropped), of ``total`` rows.

    Keys with more than a ``HOT``-th of all rows (at least ``HOT`` rows) are ``HOT`` at most: they are
    broadcast, so that their rows stay where they are. The others are joined by a shuffle; without
    such keys it is a plain join. most is the largest size, where small is a written table
    of known sizes; else small is written first, as the plan would hold it three times.
    """
    if most is None:
        small = materialise(small, "keys")
        most = small.agg(F.max(size)).first()[0]
    many = max(HOT, total // HOT)
    if (most or 0) <= many:
        return rows.join(small.drop(size), key)
    hot = F.col(size) > many
    few = F.broadcast(small.filter(hot).drop(size))
    rest = rows.join(few.select(key), key, "left_anti").join(small.filter(~hot).drop(size), key)
    return rest.unionByName(rows.join(few, key))


def components(links: DataFrame) -> DataFrame:
    """uid, comp: the smallest node of the component, for every node of links (a, b).

    Alternating large-star and small-star steps, until every edge leads from a node of no other edge
    to one that is the smallest of its edges; the tables lie in the shared folder, the driver reads
    counts alone.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = near.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("size"), F.count_if(F.col("b") < F.col("a")).alias("up"))
        nodes = materialise(nodes.select("a", F.least("a", "m").alias("m"), "size", "up"), "nodes")
        n, most, up, middle = nodes.agg(F.sum("size"), F.max("size"), F.max("up"), F.max(F.least("up", "size"))).first()
        if not n or up == 1 and middle == 0:
            return nodes.select(F.col("a").alias("uid"), F.col("m").alias("comp"))
        large = joined(near.filter("b > a"), nodes.select("a", "m", "size"), "a", "size", n, most).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")), "least")
        n, most = least.agg(F.sum("size"), F.max("size")).first()
        small = joined(large, least, "a", "size", n, most).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "small")


def _block(threshold: float):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        hashes, counts, *_ = run_hashes(block.column("text").combine_chunks())
        uid, comp, upper = (block.column(c).to_numpy() for c in ("uid", "comp", "upper"))
        row, distinct, weights = bag(hashes, counts)
        # a run that occurs w times is w tokens; tokens of one text alone don't matter
        row, token = np.repeat(row, weights), np.repeat(distinct, weights)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(weights) - weights, weights)
        _, token, df = np.unique(token + nth.astype(np.uint64) * _GOLD, return_inverse=True, return_counts=True)
        common = np.cumsum(df > 1) - 1
        on = df[token] > 1
        row, token = row[on], common[token[on]]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        cross = upper.any() and not upper.all()
        one, two = (np.flatnonzero(~upper), np.flatnonzero(upper)) if cross else (np.arange(len(uid)), np.arange(len(uid)))
        both = np.zeros((len(one), len(two)), np.float32)
        ends = np.searchsorted(token, np.arange(0, int(df.size and (df > 1).sum()) + COLUMNS, COLUMNS))
        for k in range(len(ends) - 1):
            part = slice(ends[k], ends[k + 1])
            m = np.zeros((len(uid), COLUMNS), np.float32)
            m[row[part], token[part] - k * COLUMNS] = 1
            both += m[one] @ m[two].T
        whole = counts[one][:, None] + counts[two][None, :] - both
        near = (both >= threshold * whole - 1e-6) & (both > 0) & (comp[one][:, None] != comp[two][None, :])
        head = {c: c for c in set(comp.tolist())}

        def find(c: int) -> int:
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        links = []
        for i, j in zip(*np.nonzero(near)):
            x, y = find(int(comp[one[i]])), find(int(comp[two[j]]))
            if x != y:
                head[max(x, y)] = min(x, y)
                links.append((int(uid[one[i]]), int(uid[two[j]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _across(shared: DataFrame, comp: DataFrame, texts: DataFrame, threshold: float, total: int) -> DataFrame | None:
    """Links between members of one group of buckets that lie in different components. shared: bucket, uid, n of ``total`` texts at most."""
    members = shared.join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    held = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("uid").alias("head"), F.count("*").alias("size")).filter("low <> high").select("bucket", "head", "size")
    mixed_ = materialise(joined(members, held, "bucket", "size", BANDS * total).select("uid", "n", "comp", "head").distinct(), "mixed")
    if mixed_.isEmpty():
        return None
    groups = components(mixed_.select(F.col("uid").alias("a"), F.col("head").alias("b"))).withColumnRenamed("comp", "group")
    single = mixed_.select("uid", "n", "comp").distinct().join(groups, "uid")
    sizes = single.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_RUNS)).cast("int").alias("chunks"), F.count("*").alias("size"))
    dealt = materialise(joined(single, sizes, "group", "size", total).withColumn("chunk", F.pmod(F.xxhash64("uid"), "chunks").cast("int")), "dealt")
    wanted = _involved(dealt.select(F.col("uid").alias("a"), F.col("uid").alias("b")), texts, "mixed-texts")
    rows = dealt.join(wanted, "uid").select("group", "uid", "comp", "text", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("group", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).alias("upper"), "uid", "comp", "text")
    return materialise(rows.groupBy("group", "low", "high").applyInArrow(_block(threshold), "a long, b long"), "across")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, class_id: str = "class_id", keep: str = "keep") -> DataFrame:
    """All columns of docs, class_id (the smallest doc_id of the class) and keep (true for one row of each class).

    Rows with equal words are one class; texts without words (null is empty) are one class where the
    texts are equal. Repeated rows and equal ids are one class by their texts, and one row is kept:
    that of the smallest doc_id, ties to the first row. An empty table gives no rows. class_id and
    keep must not be columns of docs (ValueError). Tables are written to the shared folder.
    """
    absent(docs, class_id, keep)
    columns = list(docs.columns)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    rows = source.mapInArrow(_signed, f"row {kind}, text string, digest binary, n long, bands array<long>")
    rows = materialise(rows.select("row", *([] if text in columns else ["text"]), "digest", "n", "bands", F.monotonically_increasing_id().alias("uid")), "signed")
    whole = F.col(f"row.`{text}`") if text in columns else F.col("text")
    first = F.struct(F.col(f"row.`{doc_id}`").alias("id"), "uid")
    reps = rows.groupBy("digest").agg(F.min("uid").alias("uid"), F.min(first).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    reps = materialise(reps, "reps")

    members = reps.select("uid", "n", F.explode("bands").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min(F.struct("uid", "n")).alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    total, texts_ = reps.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    shared = materialise(joined(members, pivots, "bucket", "size", BANDS * texts_), "shared")
    near = F.least("n", "pivot.n") >= threshold * F.greatest("n", "pivot.n")
    pairs = materialise(shared.filter((F.col("uid") != F.col("pivot.uid")) & near).select(F.col("uid").alias("a"), F.col("pivot.uid").alias("b")).distinct(), "pairs")
    texts = rows.select("uid", whole.alias("text"))
    links = _links(pairs, texts, threshold, "links")
    comp = materialise(components(links), "components")
    more = _across(shared.select("bucket", "uid", "n"), comp, texts, threshold, texts_)
    if more is not None and not more.isEmpty():
        stars = comp.filter("uid <> comp").select(F.col("uid").alias("a"), F.col("comp").alias("b"))
        comp = materialise(components(stars.unionAll(more)), "components")

    owned = reps.select("uid", "digest", "first", "copies").join(comp, "uid", "left").select("digest", "first", "copies", F.coalesce("comp", "uid").alias("comp"))
    heads = owned.groupBy("comp").agg(F.min("first").alias("head"), F.count("*").alias("size"))
    classes = joined(owned, heads, "comp", "size", texts_).select("digest", "head", "copies")
    found = joined(rows.select("row", "digest", "uid"), materialise(classes, "classes"), "digest", "copies", total)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("head.id").alias(class_id), (F.col("uid") == F.col("head.uid")).alias(keep))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "keep")
