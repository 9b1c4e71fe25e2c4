"""Exact nearest neighbours among numeric vectors, without comparing all pairs.

A tree of cuts, fitted on a bounded sample of the training rows, deals all of them out in cells of
about equal size; the box of each cell is found from all of its rows. A query first looks into its
own cell, which bounds the distance to its k-th neighbour; then only into the cells whose box is not
farther than that. No cell beyond can hold a nearer row, so the result is that of all pairs, while the
rows compared are those of a few cells a query as long as the vectors have few dimensions.

Cells are shared out as groups of a bounded number of training rows and of queries, so neither a
large cell nor many queries of one cell meet in one task. The driver holds the tree alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.operators.order import kept

#: Training rows of a cell, about; queries of a group; and the most cells. Beyond so many cells they hold more rows each.
CELL_ROWS, QUERY_ROWS, MOST_CELLS = 1024, 4096, 1 << 16
#: Sampled rows for each cell to be cut.
SAMPLED = 16


class CellTree:
    """Cuts of a complete binary tree (node i has the children 2i + 1 and 2i + 2) and the boxes of its nodes."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.leaves = depth, 1 << depth
        self.axis, self.cut = np.zeros(self.leaves - 1, np.int32), np.zeros(self.leaves - 1)
        rows = [sample]
        for node in range(self.leaves - 1):
            part, rows[node] = rows[node], np.empty(0)
            axis, cut = 0, 0.0
            if len(part):
                axis = int((np.quantile(part, 0.9, axis=0) - np.quantile(part, 0.1, axis=0)).argmax())
                if part[:, axis].min() == part[:, axis].max():
                    axis = int((part.max(0) - part.min(0)).argmax())
                cut = float(np.median(part[:, axis]))
                if not (part[:, axis] < cut).any():  # many rows of one value: they go one way
                    above = part[:, axis][part[:, axis] > cut]
                    cut = float(above.min()) if len(above) else cut
            self.axis[node], self.cut[node] = axis, cut
            low = part[:, axis] < cut if len(part) else np.empty(0, bool)
            rows += [part[low], part[~low]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] >= self.cut[at])
        return at - (self.leaves - 1)

    def filled(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        """Take the rows and the boxes of the cells that have any."""
        nodes, dims = 2 * self.leaves - 1, low.shape[1]
        self.low, self.high, self.count = np.full((nodes, dims), np.inf), np.full((nodes, dims), -np.inf), np.zeros(nodes, np.int64)
        at = leaf + self.leaves - 1
        self.low[at], self.high[at], self.count[at] = low, high, count
        for node in range(self.leaves - 2, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
            self.count[node] = self.count[a] + self.count[b]
        # how many levels up a cell has over k rows around it
        self.up = np.zeros(self.leaves, np.int64)
        at = np.arange(self.leaves) + self.leaves - 1
        for _ in range(self.depth):
            few = self.count[at] <= k
            self.up += few
            at = np.where(few, (at - 1) // 2, at)

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that hold over k rows next to each row: its own, or those under the same node."""
        own = self.leaf(x)
        up = self.up[own]
        size = 1 << up
        row = np.repeat(np.arange(len(x)), size)
        cell = np.repeat((own >> up) << up, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        some = self.count[cell + self.leaves - 1] > 0
        return row[some], cell[some]

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the other cells whose box is within the radius of each row."""
        own = self.leaf(x)
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        limit = radius * radius * (1 + 1e-9) + 1e-12
        for level in range(self.depth + 1):
            away = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0.0)
            near = (self.count[node] > 0) & ((away * away).sum(1) <= limit[row])
            row, node = row[near], node[near]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.repeat(2 * node + 1, 2)
                node[1::2] += 1
        cell = node - (self.leaves - 1)
        up = self.up[own[row]]
        new = cell >> up != own[row] >> up
        return row[new], cell[new]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


class NeighbourSearch:
    """The training rows in cells; ``nearest`` finds the k nearest of them for queries.

    Vectors are arrays of finite numbers of one length; rows of a null vector are left out. Of equal
    vectors only the k + 1 smallest keys can be among neighbours, so the others are left out too.
    """

    def __init__(self, train: DataFrame, k: int, key: str = "id", x: str = "x", rows: int = CELL_ROWS):
        self.k, self.key, self.x, self.visits = k, key, x, []
        part = W.partitionBy("x", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")  # copies are thinned before they meet
        rows_ = train.filter(F.col(x).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
        few = rows_.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
        few = few.withColumn("n", F.row_number().over(W.partitionBy("x").orderBy("id"))).filter(F.col("n") <= k + 1).select("id", "x")
        few = kept(few)
        n = few.count()
        depth = max(0, min(int(MOST_CELLS).bit_length() - 1, int(np.ceil(np.log2(max(n / rows, 1))))))
        size = SAMPLED << depth
        drawn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30))
        some = few.filter(drawn < int(min(1.0, 1.2 * size / max(n, 1)) * (1 << 30))).select("x").limit(2 * size).collect() if depth else []
        self.tree = tree = CellTree(np.array([r.x for r in some], float).reshape(len(some), -1), depth) if some else CellTree(np.empty((0, 1)), 0)

        def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield p.assign(cell=tree.leaf(_matrix(p["x"])).astype(np.int32) if len(p) else np.empty(0, np.int32))

        self.train = kept(few.mapInPandas(dealt, "id long, x array<double>, cell int")) if tree.depth else few.withColumn("cell", F.lit(0))
        dims = len((self.train.select("x").first() or [[0.0]])[0])
        edges = [f(F.col("x")[i]).alias(f"{n_}{i}") for n_, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
        boxes = self.train.groupBy("cell").agg(F.count("*").alias("n"), *edges).collect()  # a row a cell
        box = lambda n_: np.array([[r[f"{n_}{i}"] for i in range(dims)] for r in boxes], float).reshape(-1, dims)
        tree.filled(np.array([r.cell for r in boxes], np.int64), np.array([r.n for r in boxes], np.int64), box("low"), box("high"), k)
        self.rows = rows

    def _searched(self, visits: DataFrame) -> DataFrame:
        """id, neighbour, distance: of each visit (id, x, radius, cell) the k nearest rows of the cell within the radius."""
        k, tree = self.k, self.tree
        visits = kept(visits)
        counts = visits.groupBy("cell").agg(F.count("*").alias("asked"))
        self.visits.append(counts)
        size = {int(c): int(tree.count[c + tree.leaves - 1]) for c in range(tree.leaves)}
        table = [(r.cell, -(-size[r.cell] // (4 * self.rows)), -(-r.asked // QUERY_ROWS)) for r in counts.collect()]  # a row a cell
        if not table:
            return visits.sparkSession.createDataFrame([], "id long, neighbour long, distance double")
        dealt = F.broadcast(visits.sparkSession.createDataFrame(table, "cell int, parts int, turns int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
        left = visits.join(dealt, "cell").select("id", "x", "radius", "cell", every("parts").alias("part"), of("turns", 2).alias("turn"))
        right = self.train.join(dealt, "cell").select("id", "x", "cell", of("parts", 3).alias("part"), every("turns").alias("turn"))

        def search(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(qs) and len(ts):
                ids, t = ts["id"].to_numpy(), _matrix(ts["x"])
                for i in range(0, len(qs), 64):
                    own, q, limit = qs["id"].to_numpy()[i : i + 64], _matrix(qs["x"][i : i + 64]), qs["radius"].to_numpy()[i : i + 64]
                    d = np.sqrt(((q[:, None, :] - t[None]) ** 2).sum(2))
                    d[own[:, None] == ids[None]] = np.inf
                    bound = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                    a, b = np.nonzero((d <= np.minimum(bound, limit)[:, None]) & np.isfinite(d))
                    order = np.lexsort((ids[b], d[a, b], a))
                    a, b = a[order], b[order]
                    near = np.arange(len(a)) - np.searchsorted(a, a) < k
                    a, b = a[near], b[near]
                    found.append((own[a], ids[b], d[a, b]))
            cols = [np.concatenate(v) for v in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pd.DataFrame(dict(zip(("id", "neighbour", "distance"), cols)))

        group = ["cell", "part", "turn"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, "id long, neighbour long, distance double")

    def nearest(self, queries: DataFrame) -> DataFrame:
        """key, n (rank from 1), neighbour, distance: the k nearest training rows other than the row itself, ties by key.

        Keys of queries tell rows apart; a query of a null vector has no neighbours. Fewer than k
        training rows are all listed; without any there are no rows.
        """
        tree, k = self.tree, self.k
        asked = queries.filter(F.col(self.x).isNotNull()).select(F.col(self.key).cast("long").alias("id"), F.col(self.x).cast("array<double>").alias("x"))
        step = max(1, (1 << 21) // tree.leaves)
        schema = "id long, x array<double>, radius double, cell int"

        def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i in range(0, len(p), step):
                    some = p.iloc[i : i + step]
                    row, cell = tree.around(_matrix(some["x"]))
                    yield some.iloc[row].assign(radius=np.inf, cell=cell.astype(np.int32))

        def others(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i in range(0, len(p), step):
                    some = p.iloc[i : i + step]
                    row, cell = tree.within(_matrix(some["x"]), some["radius"].to_numpy(float))
                    yield some.iloc[row].assign(cell=cell.astype(np.int32))

        ranked = lambda df: df.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))).filter(F.col("n") <= k)
        self.visits = []
        found = ranked(self._searched(asked.mapInPandas(first, schema)))
        if tree.depth:
            found = kept(found.select("id", "neighbour", "distance"))
            radius = found.groupBy("id").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf")).alias("radius"))
            more = asked.join(radius, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
            found = ranked(found.unionByName(self._searched(more.mapInPandas(others, schema))))
        return found.select(F.col("id").alias(self.key), "n", "neighbour", "distance")

    def compared(self) -> int:
        """Pairs of rows that the last call of ``nearest`` compared."""
        tree = self.tree
        return sum(r.asked * int(tree.count[r.cell + tree.leaves - 1]) for counts in self.visits for r in counts.collect())  # a row a cell
