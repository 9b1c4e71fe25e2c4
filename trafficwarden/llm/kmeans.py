"""Centroid clustering of integer vectors with a filter in rotated coordinates.

The vectors are rotated to their principal axes; each is kept with its leading coordinates and the
norm of the rest. For a centroid so rotated, the squared distance of the leading coordinates plus the
squared difference of the two norms can't exceed the squared distance of the whole vectors, so a
centroid whose bound is over the distance to a nearer one is passed by. The others are compared in
whole numbers, hence the result is that of plain rounds, whatever the rotation.

The vectors are written once, with their coordinates. A round is one narrow pass: each task sends the
sums of its vectors by cluster, (clusters x components) whole numbers, which are added up by cell;
only those sums pass the driver. No group holds the vectors of a cluster, so its size doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import materialise

#: Components of a vector, clusters, rounds, and what a component is multiplied by.
DIMS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Leading coordinates that a vector is kept with.
LEADING = 24
#: Components must be under this, so that squared distances fit 64 bits.
LARGEST = 2.0**19
#: Rows that a task compares at once.
ROWS = 4096


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component. Fails for components of 2**19 or more (scale 256)."""
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= LARGEST * SCALE)
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(floors)


class Rotated:
    """Centroids as whole numbers, with their leading rotated coordinates and the norms of the rest."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, rotation: np.ndarray):
        self.centroids, self.mean, self.rotation = centroids.astype(np.int64), mean, rotation
        self.lead, self.rest, self.norm = self.project(self.centroids)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leading coordinates, norm of the rest, squared norm) of the rows, about the mean."""
        away = x - self.mean
        lead, norm = away @ self.rotation, (away * away).sum(1)
        return lead, np.sqrt(np.maximum(norm - (lead * lead).sum(1), 0.0)), norm

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, compared pairs): ties to the smaller number."""
        c, rows = self.centroids, np.arange(len(x))
        own = (lead * lead).sum(1)
        bound = own[:, None] + (self.lead**2).sum(1) - 2 * lead @ self.lead.T + (rest[:, None] - self.rest) ** 2
        # coordinates are kept in 32 bits: what rounding can add is far below this
        slack = 1e-5 * ((own + rest * rest)[:, None] + self.norm) + 1e-3

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.empty(len(i), np.int64)
            for a in range(0, len(i), 1 << 15):
                d = x[i[a : a + (1 << 15)]] - c[j[a : a + (1 << 15)]]
                out[a : a + (1 << 15)] = np.einsum("ij,ij->i", d, d)
            return out

        first = bound.argmin(1)
        least = exact(rows, first)
        distance = np.full(bound.shape, np.iinfo(np.int64).max)
        distance[rows, first] = least
        i, j = np.nonzero(bound - slack <= least[:, None])
        other = j != first[i]
        i, j = i[other], j[other]
        distance[i, j] = exact(i, j)
        best = distance.argmin(1)
        return best, distance[rows, best], len(rows) + len(i)


def _arrays(batch: pa.RecordBatch, dims: int, at: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows of a batch with their vectors (column ``at``) as whole numbers."""
    for a in range(0, batch.num_rows, ROWS):
        part = batch.column(at).slice(a, ROWS)
        yield a, len(part), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _summed(cells: DataFrame) -> np.ndarray:
    """Sums of (cell, value) over all tasks, as rows of cell and whole sum; as many rows as there are cells."""
    return cells.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()


def axes(vectors: DataFrame, dims: int, leading: int, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the leading principal axes as columns, of all vectors: dims x dims sums meet, no vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            for _, n, v in _arrays(batch, dims):
                v = np.hstack([v.astype(float), np.ones((n, 1))])
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    found = vectors.select(x).mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((dims + 1) ** 2)
    for r in found:
        total[r.cell] = r.value
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :dims] / n
    values, turned = np.linalg.eigh(total[:dims, :dims] / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(turned[:, np.argsort(-values)[:leading]])


def clustered(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dims: int = DIMS, scale: int = SCALE, seed: int = 2, leading: int = LEADING,
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid of every vector that takes part.

    Vectors of another length than dims, null ones, and such with null or non-finite components are
    left out. The rest become whole numbers. Centroids start as the vectors of the smallest hex SHA-256
    of ``seed:key``, in that order (ties, as of repeated keys, by their components; a null key is an
    empty one); with fewer vectors than clusters there are so many clusters. Each round assigns all
    vectors (ties to the smaller cluster) and moves each centroid that has any to the floor of their
    mean; then all are assigned once more. Repeated rows count each. An empty table gives no rows.
    Components of 2**19 or more raise an error. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    numbers = vectors.filter(v.isNotNull() & (F.size(v) == dims) & finite).select(F.col(f"`{key}`").cast("long").alias("key"), whole_numbers(v, scale).alias("x"))
    mean, rotation = axes(numbers, dims, min(leading, dims))
    plain = spark.sparkContext.broadcast(Rotated(np.zeros((1, dims), np.int64), mean, rotation))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, x in _arrays(batch, dims, 1):
                lead, rest, _ = plain.value.project(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * lead.shape[1]), pa.array(lead.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, n) for i in range(2)], lists, pa.array(rest.astype(np.float32))], ["key", "x", "lead", "rest"])

    rows = materialise(numbers.mapInArrow(projected, "key long, x array<int>, lead array<float>, rest float"), "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.x for r in rows.select("x", draw.alias("h")).orderBy("h", "x").limit(clusters).collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "key long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>").withColumnRenamed("key", key)

    def parts(batch: pa.RecordBatch, state: Rotated) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
        width = state.rotation.shape[1]
        for a, n, x in _arrays(batch, dims):
            lead = batch.column(1).slice(a, n).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
            yield a, n, x, *state.nearest(x, lead, batch.column(2).slice(a, n).to_numpy(zero_copy_only=False).astype(float))

    def sums(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of each cluster the sums of its vectors' components, then the number of vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(shared.value.centroids)
            total = np.zeros((k, dims + 1), np.int64)
            for batch in batches:
                for _, n, x, best, *_ in parts(batch, shared.value):
                    order = np.argsort(best, kind="stable")
                    here, first = np.unique(best[order], return_index=True)
                    total[here, :dims] += np.add.reduceat(x[order], first, axis=0)
                    total[here, dims] += np.diff(np.append(first, n))
            cells = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells])], ["cell", "value"])

        return run

    measured = rows.select("x", "lead", "rest")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Rotated(centroids, mean, rotation))
        total = np.zeros((len(centroids) * (dims + 1)), object)
        for r in _summed(measured.mapInArrow(sums(shared), "cell int, value long")):
            total[r.cell] = int(r.value)
        total = total.reshape(-1, dims + 1)
        moved = [[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(total, centroids)]
        centroids = np.array(moved, np.int64)
        shared.unpersist()
    last = spark.sparkContext.broadcast(Rotated(centroids, mean, rotation))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays(batch.columns[1:], ["x", "lead", "rest"])
            for a, n, _, best, distance, compared in parts(whole, last.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(best.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    out = materialise(rows.mapInArrow(assigned, "key long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    table = [(k, inertia.get(k, 0), sum(inertia.values()), c) for k, c in enumerate(centroids.tolist())]
    table = F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>"))  # a row a cluster
    return out.join(table, "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster after five rounds of forty centroids, and a last assignment."""
    out = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256"))


def _sql() -> str:
    near = """SELECT i, vec_id, x, k AS cluster, d AS distance FROM (SELECT v.*, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d,
  row_number() OVER (PARTITION BY v.i ORDER BY d, c.k) AS n FROM v, c{r} c) WHERE n = 1"""
    # floor of sum over count, in whole numbers
    moved = """SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(q ORDER BY j) AS x FROM
  (SELECT cluster, j, CAST((sum(u) - ((sum(u) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM (SELECT cluster, unnest(x) AS u, unnest(range(1, 65)) AS j FROM a{r}) GROUP BY cluster, j) GROUP BY cluster) m ON m.cluster = c.k"""
    steps = "".join(f",\na{r} AS MATERIALIZED ({near.format(r=r)}),\nc{r + 1} AS MATERIALIZED ({moved.format(r=r)})" for r in range(ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x FROM v QUALIFY k < 40){steps},
f AS MATERIALIZED ({near.format(r=ROUNDS)})
SELECT f.vec_id, CAST(f.cluster AS INTEGER) AS cluster, CAST(f.distance AS BIGINT) AS distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c ON c.k = f.cluster"""


OP13_SQL = _sql()
