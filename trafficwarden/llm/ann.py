"""Approximate nearest neighbours by inner product: an inverted file with an adaptive dimension scan.

Equal vectors are found first and searched once; of each at most ``top + 1`` smallest ids can ever be
among the nearest, so no more are kept. An extra coordinate gives all vectors one length, which turns
the largest inner product into the smallest distance. K-means on a bounded sample gives the lists;
every vector is in the list of its nearest centre, and a query probes its nearest lists. How many is
measured: some rows of the sample, of each list too, are compared with all rows, and so many lists are
probed as hold ``TARGET`` of those true neighbours. Further lists are added until they are known to hold
several times the ids asked for.

Small lists lie together in a shard and large ones are a shard each; a shard is dealt out in blocks of
bounded size, and so are its queries, so a task holds one block of each and a query is sent once to a
block, with the lists it probes there. Each query starts with a bound, its distance to a near row of the
sample: twice as many rows of its lists as are asked for lie within, so that it gets enough although the
scan may lose a few. In a list the vectors, rotated at random, are scanned in blocks
of columns: from the partial distance over the first d of D columns a hypothesis test tells that the whole
distance can't be among the best so far (partial > bound * d / D * (1 + ``EPSILON`` / sqrt(d)) ** 2, Gao
and Long 2023), and the candidate is abandoned. What remains gets the exact inner product of the original
vectors in double precision; the best of all blocks are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.llm.common import materialise

TOP = 20
#: Bounds: sample that the centres are fitted on, and lists.
SAMPLE, LISTS = 16_384, 1024
#: Queries probe so many lists that this part of the true neighbours lies in them, for all tried rows and for those of their list.
TARGET, TARGET_EACH = 0.96, 0.9
#: Rows tried: of the whole sample, and of each list.
TRIED, TRIED_EACH = 512, 2
#: The probed lists hold at least so many times the ids asked for, or are all lists.
AMPLE = 4
#: Columns scanned at once, and the slack of the test.
COLUMNS, EPSILON = 16, 2.1
#: Rows of a block of vectors, of queries, and vectors between two updates of the bounds.
BLOCK, QUERIES, STEP = 4096, 4096, 512
#: A query vector that more rows than this share has its rows dealt out in parts.
SHARED = 50_000


def usable(vector: Column) -> Column:
    """Not null or zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Lists:
    """Centres and rotation, fitted on a sample of vectors of at most the given squared length."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.sample = sample
        x = self.level(sample)
        centres = x[rng.permutation(len(x))[:lists]].copy()
        for _ in range(8):
            near = self._nearest(x, centres)
            n = np.bincount(near, minlength=len(centres))
            for k in range(x.shape[1]):
                mean = np.bincount(near, x[:, k], len(centres)) / np.maximum(n, 1)
                centres[:, k] = np.where(n > 0, mean, centres[:, k])
        # lists that lie near one another along the main axis get near numbers, and so shards in common
        axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
        self.centres = centres[np.argsort(centres @ axis)]
        self.of_sample = self.of(sample)
        self.rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0].astype(np.float32)
        # rows that tell how many lists to probe: some of all, and some of each list
        drawn = rng.permutation(len(sample))
        home = np.concatenate([self.probes(part, 1)[:, 0] for part in np.array_split(sample, -(-len(sample) // 2048))])
        order = drawn[np.argsort(home[drawn], kind="stable")]
        each = order[np.arange(len(order)) - np.searchsorted(home[order], home[order]) < TRIED_EACH]
        self.common = min(TRIED, len(sample))
        self.tried = np.concatenate([drawn[: self.common], each])
        self.home = home[self.tried]

    def level(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more coordinate: what the squared length lacks to the longest; nought for queries."""
        x = x.astype(np.float64)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.level(x), self.centres)

    def probes(self, q: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists by direction, nearest first: queries are scaled to the common length."""
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1, keepdims=True))
        x = self.level(q / length * np.sqrt(self.longest), True)
        return np.argsort((self.centres * self.centres).sum(1) - 2 * x @ self.centres.T, axis=1)[:, :k]

    def least(self, q: np.ndarray, wanted: int, probes: np.ndarray | None = None) -> np.ndarray:
        """For each query an inner product that at least ``wanted`` rows of the sample (in its lists, if given) reach; -inf with fewer rows."""
        at = len(self.sample) - wanted
        if at < 0:
            return np.full(len(q), -np.inf, np.float32)
        score = q.astype(np.float32) @ self.sample.astype(np.float32).T
        if probes is not None:
            score[~probes[:, self.of_sample]] = -np.inf
        return np.partition(score, at, axis=1)[:, at]

    def measure(self, row: np.ndarray, of_list: np.ndarray) -> np.ndarray:
        """How many lists to probe, by nearest list: from (tried row, list that holds one of its neighbours)."""
        lists = len(self.centres)
        if not len(row):
            return np.ones(lists, np.int64)
        place = np.empty(len(row), np.int64)
        for k in np.array_split(np.arange(len(row)), -(-len(row) // 2048)):
            at = np.argsort(self.probes(self.sample[self.tried[row[k]]], lists), axis=1)
            place[k] = at[np.arange(len(k)), of_list[k]]
        common = place[row < self.common]
        enough = np.full(lists, int(np.quantile(common, TARGET)) + 1 if len(common) else 1)
        home = self.home[row]
        for h in np.unique(home):
            enough[h] = max(enough[h], int(np.quantile(place[home == h], TARGET_EACH)) + 1)
        return enough

    def probed(self, q: np.ndarray, enough: np.ndarray, held: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists end to end, number for each row): as measured, and on until the lists hold so many ids (``held``: ids of each list)."""
        order = self.probes(q, len(self.centres))
        short = (np.cumsum(held[order], axis=1) < ids).sum(1) + 1
        n = np.minimum(np.maximum(short, enough[order[:, 0]]), order.shape[1])
        return order[np.arange(order.shape[1]) < n[:, None]].astype(np.int32), n


class Best:
    """The best ``wanted`` distances of each query so far; the last of them is its bound."""

    def __init__(self, bound: np.ndarray, wanted: int):
        self.bound, self.wanted = bound, wanted
        self.kept = np.full((len(bound), wanted), np.inf, np.float32)

    def add(self, qi: np.ndarray, dist: np.ndarray) -> None:
        if not len(qi):
            return
        order = np.lexsort((dist, qi))
        qs = qi[order]
        place = np.arange(len(qs)) - np.searchsorted(qs, qs)
        near = place < self.wanted
        touched, at = np.unique(qs[near], return_inverse=True)
        fresh = np.full((len(touched), self.wanted), np.inf, np.float32)
        fresh[at, place[near]] = dist[order][near]
        self.kept[touched] = np.sort(np.concatenate([self.kept[touched], fresh], axis=1), axis=1)[:, : self.wanted]
        self.bound[touched] = np.minimum(self.bound[touched], self.kept[touched, -1])


def adaptive_scan(
    x: np.ndarray, q: np.ndarray, wanted: int, rotation: np.ndarray, longest: float,
    of_list: np.ndarray, probes: np.ndarray, least: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, inner product) of the nearest of x for each row of q, more or less ``wanted`` each.

    ``of_list`` numbers the list of each vector, ``probes[query, list]`` tells which are scanned, and
    ``least`` is an inner product that enough other rows reach (-inf if unknown).
    """
    dims = x.shape[1] + 1
    rest = np.sqrt(np.maximum(longest - (x.astype(np.float64) ** 2).sum(1), 0))
    xr = np.concatenate([x, rest[:, None]], axis=1).astype(np.float32) @ rotation
    scale = np.sqrt(longest) / np.sqrt((q.astype(np.float64) ** 2).sum(1))
    qr = np.concatenate([q * scale[:, None], np.zeros((len(q), 1))], axis=1).astype(np.float32) @ rotation
    bound = np.where(np.isfinite(least), 2 * longest - 2 * scale * least, np.inf)  # both have the longest length
    best = Best((bound + 1e-4 * np.abs(longest)).astype(np.float32), wanted)
    cuts = [*range(0, dims, COLUMNS), dims]
    slack = [(d / dims) * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dims else 1 + 1e-5 for d in cuts[1:]]
    head = cuts[1]
    q2, x2 = (qr[:, :head] ** 2).sum(1), (xr[:, :head] ** 2).sum(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(of_list, kind="stable")
    ends = np.searchsorted(of_list[order], np.arange(probes.shape[1] + 1))
    for k in range(probes.shape[1]):
        who = np.flatnonzero(probes[:, k])
        for begin in range(ends[k], ends[k + 1], STEP) if len(who) else ():
            some = order[begin : min(begin + STEP, ends[k + 1])]
            # partial <= limit, as q.x >= (q.q + x.x - limit) / 2
            least_dot = (q2[who] - slack[0] * best.bound[who])[:, None] + x2[some]
            dot = qr[who, :head] @ xr[some, :head].T
            qi, xi = np.nonzero(2 * dot >= least_dot)
            dist = q2[who[qi]] + x2[some[xi]] - 2 * dot[qi, xi]
            qi, xi = who[qi], some[xi]
            for low, high, more in zip(cuts[1:-1], cuts[2:], slack[1:]):
                diff = qr[qi, low:high] - xr[xi, low:high]
                dist = dist + np.einsum("ij,ij->i", diff, diff)
                on = dist <= more * best.bound[qi]
                qi, xi, dist = qi[on], xi[on], dist[on]
            found.append((qi, xi, dist))
            best.add(qi, dist)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qi, xi, dist = (np.concatenate(v) for v in zip(*found))
    on = dist <= best.bound[qi] * (1 + 1e-4) + 1e-6
    qi, xi = qi[on], xi[on]
    return qi, xi, np.einsum("ij,ij->i", q[qi].astype(np.float64), x[xi].astype(np.float64))


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _shards(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each list, blocks of each shard): large lists alone, small ones together up to a block."""
    shard, rows = np.empty(len(sizes), np.int32), [0]
    for k, n in enumerate(sizes):
        if rows[-1] and rows[-1] + n > BLOCK:
            rows.append(0)
        shard[k] = len(rows) - 1
        rows[-1] += int(n)
    return shard, np.maximum(-(-np.array(rows) // BLOCK), 1)


def nearest(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP,
    sample: int = SAMPLE, lists: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows where ``queries`` holds, their nearest other rows.

    Null vectors, zero ones, and such with null or non-finite components take no part, nor do rows of
    a null id. Vectors of different lengths are searched apart, each length among its own. Ties go to the
    smaller vec_id. With fewer candidates all are returned; an empty table gives no rows. Rows of equal
    ids are rows of their own: each has a ranking, in which the others may be. Other columns play no part.
    """
    spark: SparkSession = vectors.sparkSession
    kind = "double" if vectors.schema[vector].dataType.elementType.simpleString() == "double" else "float"
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col(vector)))
    found = [
        _nearest_of(rows.filter(F.size("v") == r.dims), "<f8" if kind == "double" else "<f4", top, sample, lists)
        for r in rows.groupBy(F.size("v").alias("dims")).agg(F.count("*")).orderBy("dims").collect()
    ]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of(rows: DataFrame, kind: str, top: int, sample: int, lists: int | None) -> DataFrame:
    """The search among vectors of one length, of which there is one at least."""
    spark, wanted = rows.sparkSession, top + 1
    # two hashes of 64 bits name a vector
    rows = rows.withColumn("name", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    # equal vectors are one; the smallest ids of each are enough. Copies are thinned before they meet.
    salted = W.partitionBy("name", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= wanted)
    one = few.groupBy("name").agg(F.first("v").alias("v"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, wanted).alias("ids"))
    one = materialise(one.withColumn("key", F.monotonically_increasing_id()), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, longest = one.agg(F.count("*"), F.max(length)).first()
    lists = lists or max(1, min(LISTS, round(2 * n**0.5), n // 32))
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    some = one.filter(part < int(min(1.0, 1.2 * sample / n) * (1 << 30))).select("v", part.alias("h")).orderBy("h").limit(sample).collect()
    fitted = Lists(np.array([r.v for r in some] or [one.first().v]), longest, lists)
    shared = spark.sparkContext.broadcast(fitted)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _raw(x), batch.column(2), pa.array(shared.value.of(x).astype(np.int32))], ["key", "v", "copies", "list"])

    held = materialise(one.select("key", "v", F.size("ids").alias("copies")).mapInArrow(listed, "key long, v binary, copies int, list int"), "lists")
    sizes, copies = np.zeros(len(fitted.centres), np.int64), np.zeros(len(fitted.centres), np.int64)
    for r in held.groupBy("list").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect():  # at most LISTS rows
        sizes[r["list"]], copies[r["list"]] = r.n, r.copies

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of a partition for each tried row: of all rows that beat those of the sample."""
        tried = shared.value.sample[shared.value.tried].astype(np.float32)
        least = np.concatenate([shared.value.least(t, wanted) for t in np.array_split(tried, -(-len(tried) // 256))])
        best, kept = Best(-least, wanted), []

        def pruned() -> list[tuple[np.ndarray, ...]]:
            row, score, at = (np.concatenate(v) for v in zip(*kept))
            on = -score <= best.bound[row]
            return [(row[on], score[on], at[on])]

        for batch in batches:
            raw, of_list = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for i in range(0, len(raw), 1024):
                x = np.frombuffer(b"".join(raw[i : i + 1024]), kind).reshape(-1, tried.shape[1]).astype(np.float32)
                score = tried @ x.T
                row, at = np.nonzero(score >= -best.bound[:, None])
                kept.append((row, score[row, at], of_list[i + at]))
                best.add(row, -kept[-1][1])
                if sum(len(k[0]) for k in kept) > 500_000:
                    kept = pruned()
        if kept:
            row, score, at = pruned()[0]
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(score), pa.array(at.astype(np.int32))], ["row", "score", "list"])

    # the best, most often the row itself, tells nothing; at most (TRIED + 2 LISTS) x top rows
    closest = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "list"))
    true = held.select("v", "list").mapInArrow(compared, "row int, score float, list int").withColumn("n", closest)
    true = true.filter(F.col("n").between(2, wanted)).select("row", "list").collect()
    enough = fitted.measure(np.array([r["row"] for r in true], np.int64), np.array([r["list"] for r in true], np.int64))
    shard, blocks = _shards(sizes)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard, with the lists of the shard that the query probes."""
        for batch in batches:
            whole = matrix(batch.column(1))
            for i in range(0, len(whole), 1024):
                x = whole[i : i + 1024]
                probed, n = shared.value.probed(x, enough, copies, AMPLE * top + 1)
                row = np.repeat(np.arange(len(x)), n)
                order = np.lexsort((shard[probed], row))
                row, probed = row[order], probed[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[probed][1:] != shard[probed][:-1])))
                mask = np.zeros((len(x), len(enough)), bool)
                mask[row, probed] = True
                at, least = row[first], shared.value.least(x, 2 * wanted, mask)
                of_lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(probed))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + i)), _raw(x).take(pa.array(at)), pa.array(least[at]), pa.array(shard[probed[first]]), of_lists],
                    ["query", "q", "least", "shard", "lists"])

    asked = rows.filter("asked").select("vec_id", "name")
    sought = one.select("key", "v", "name").join(asked.select("name").distinct(), "name", "left_semi").select("key", "v")
    sought = materialise(sought.mapInArrow(probing, "query long, q binary, least float, shard int, lists array<int>"), "probes")

    # blocks of each shard and of its queries; a row for each shard, so at most LISTS
    turns = {r["shard"]: -(-r.n // QUERIES) for r in sought.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    dealt = F.broadcast(spark.createDataFrame([(int(k), int(blocks[k]), int(v)) for k, v in turns.items()], "shard int, blocks int, turns int"))
    of_list = F.broadcast(spark.createDataFrame([(k, int(s)) for k, s in enumerate(shard)], "list int, shard int"))
    left = held.join(of_list, "list").join(dealt, "shard").select(
        "shard", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "key", "v", "list")
    right = sought.join(dealt, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), "turns").cast("int").alias("turn"),
        "query", "q", "least", "lists")

    def search(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(xs) or not len(qs):
            return pd.DataFrame({"query": np.empty(0, np.int64), "key": np.empty(0, np.int64), "score": np.empty(0)})
        here, at = np.unique(xs["list"].to_numpy(), return_inverse=True)
        probes = np.zeros((len(qs), shared.value.centres.shape[0]), bool)
        probes[np.repeat(np.arange(len(qs)), qs["lists"].map(len)), np.concatenate(qs["lists"].to_list())] = True
        qi, xi, score = adaptive_scan(
            _matrix(xs["v"], kind), _matrix(qs["q"], kind), wanted, shared.value.rotation, shared.value.longest,
            at, probes[:, here], qs["least"].to_numpy().astype(np.float64))
        return pd.DataFrame({"query": qs["query"].to_numpy()[qi], "key": xs["key"].to_numpy()[xi], "score": score})

    group = ["shard", "block", "turn"]
    pairs = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, "query long, key long, score double")
    ranked = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "first"))
    pairs = pairs.join(one.select("key", F.col("ids")[0].alias("first")), "key").withColumn("n", ranked).filter(F.col("n") <= wanted)
    pairs = pairs.join(one.select("key", "ids"), "key").select("query", "key", F.explode("ids").alias("vec_id"), "score")
    # of a query vector's candidates the best top + 1 ids serve all of its rows
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    pairs = pairs.withColumn("n", best).filter(F.col("n") <= wanted).drop("n")
    named = pairs.join(one.select(F.col("key").alias("query"), "name"), "query")

    # the rows of a query vector: of equal ids there is one ranking, given out as often as the id stands there
    own = asked.groupBy("name", F.col("vec_id").alias("query_id")).agg(F.count("*").alias("times"))
    hot = own.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > SHARED)
    hot = F.broadcast(hot.select("name", F.ceil(F.col("n") / SHARED).cast("int").alias("parts")))  # a row for at least SHARED rows
    parts = F.coalesce("parts", F.lit(1))
    own = own.join(hot, "name", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int"))
    named = named.join(hot, "name", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    ranking = W.partitionBy("name", "query_id").orderBy(F.desc("score"), "vec_id")
    # one row of the query's own id and vector is the query itself
    mine = (F.col("key") == F.col("query")) & (F.col("vec_id") == F.col("query_id"))
    itself = F.row_number().over(W.partitionBy("name", "query_id").orderBy(F.desc(mine), "vec_id"))
    out = own.drop("parts").join(named.drop("parts"), ["name", "part"]).withColumn("itself", mine & (itself == 1)).filter("not itself")
    out = out.withColumn("rank", F.row_number().over(ranking).cast("int")).filter(F.col("rank") <= top)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return out.withColumn("_", again).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: Exact answer in SQL, for recall.
EXACT_SQL = r"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20
"""
