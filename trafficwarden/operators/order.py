"""Global order: dense positions and running sums without a single-partition window over the rows."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all run on this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: its lineage ends there."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def running_sums(df: DataFrame, keys: list[str], values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """df with the sum of each value up to and including each row, in the order of keys (which must tell rows apart).

    bucket is a column that never falls as the keys rise (an hour, a leading digit): sums per bucket
    give each bucket its start, a window within the bucket the rest. Without one the rows are
    range-partitioned and kept by a checkpoint, so that both passes see the same partitions. A row
    for each bucket or partition meets in one task; their number doesn't depend on the rows in them.
    """
    rows = df.withColumns({f"_value_{n}": v for n, v in values.items()})
    rows = rows.withColumn("_part", bucket) if bucket is not None else kept(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = rows.groupBy("_part").agg(*[F.sum(f"_value_{n}").alias(f"_total_{n}") for n in values])
    parts = W.orderBy("_part")
    before = totals.select("_part", *[(F.sum(f"_total_{n}").over(parts) - F.col(f"_total_{n}")).alias(f"_before_{n}") for n in values])
    inner = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(f"_value_{n}").over(inner) for n in values}).join(before, "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in values}).drop("_part", *[f"{c}_{n}" for n in values for c in ("_value", "_before")])


def running_sum(df: DataFrame, keys: list[str], value: Column, out: str, bucket: Column | None = None) -> DataFrame:
    """running_sums of one value."""
    return running_sums(df, keys, {out: value}, bucket)


def with_position(df: DataFrame, keys: list[str], out: str = "position", bucket: Column | None = None) -> DataFrame:
    """df with a dense position from 0 in the order of keys (which must tell rows apart)."""
    return running_sum(df, keys, F.lit(1).cast("long"), out, bucket).withColumn(out, F.col(out) - 1)


def in_groups(df: DataFrame, group: str, keys: list[str], before: str, value: Column, out: str) -> DataFrame:
    """df with the running sum, named out, of value in each group of rows in the order of keys, up to and including each row.

    value may use ``_before``, the column named before of the row in front in its group (null for the
    first). Rows are dealt out in ranges of group and keys (which must tell rows of a group apart), so
    a group that holds most of the rows is spread over tasks. What a range must know of those in front
    of it, its last row and the sum so far of the group that it ends in, is one row a range.
    """
    rows = kept(df.repartitionByRange(group, *keys).withColumn("_part", F.spark_partition_id()))
    g, order = F.col(group), [F.col(group).asc_nulls_first(), *keys]
    place = F.struct(g.isNotNull().alias("known"), g.alias("g"), *keys)
    first, last = F.min(F.struct(place.alias("at"), F.col(before).alias("x"))), F.max(F.struct(place.alias("at"), F.col(before).alias("x")))
    parts = W.orderBy("_part")  # a row for each range
    ends = rows.groupBy("_part").agg(first.alias("first"), last.alias("last"))
    ends = ends.select("_part", F.col("first.at.g").alias("_head"), F.col("last.at.g").alias("_tail"), F.lag("last").over(parts).alias("_front"))
    met = F.col("_front").isNotNull() & F.col("_front.at.g").eqNullSafe(F.col("_head"))
    ends = kept(ends.select("_part", "_head", "_tail", met.alias("_met"), F.when(met, F.col("_front.x")).alias("_last")))
    inner = W.partitionBy("_part").orderBy(*order)
    mates = W.partitionBy("_part", group).orderBy(*keys)
    rows = rows.join(F.broadcast(ends), "_part")  # no more rows than shuffle partitions
    front = F.when(F.row_number().over(inner) == 1, F.col("_last")).otherwise(F.lag(before).over(mates))
    rows = rows.withColumn("_before", front).withColumn("_value", value)
    tails = rows.groupBy("_part").agg(F.sum(F.when(g.eqNullSafe(F.col("_tail")), F.col("_value")).otherwise(0)).alias("_sum"))
    chain = W.partitionBy("_tail").orderBy("_part")  # the ranges that end in one group
    sums = ends.join(tails, "_part").withColumn("_sum", F.sum("_sum").over(chain))
    sums = sums.select("_part", F.when(F.col("_met"), F.lag("_sum").over(parts)).otherwise(0).alias("_carry"))
    rows = rows.join(F.broadcast(sums), "_part")
    carry = F.when(g.eqNullSafe(F.col("_head")), F.col("_carry")).otherwise(0)
    total = F.sum("_value").over(mates.rowsBetween(W.unboundedPreceding, 0)) + carry
    return rows.withColumn(out, total).drop("_part", "_head", "_tail", "_met", "_last", "_value", "_carry")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores: for small rows with much work on each, which would otherwise lie in few parts."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def quantiles(df: DataFrame, by: list[str], x: str, probabilities: list[float], out: str = "q", rows: str | None = None) -> DataFrame:
    """by, out: the exact quantiles of x in each group (nulls left out), between two rows interpolated; a row for each group with a value.

    With ``rows`` each row counts as often as that column says.

    Distinct values are counted first and dealt out in ranges over all groups, so neither a large
    group nor a frequent value meets in one task. From the totals of the ranges it is known which of
    them hold a quantile; only their values are ordered. Without ``by`` the result is one row, of
    null where no row has a value.
    """
    cells = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.sum(rows).alias("_c") if rows else F.count("*").alias("_c"))
    cells = kept(cells.repartitionByRange(*by, "_x").withColumn("_part", F.spark_partition_id()))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each range
    ranges = cells.groupBy("_part", *by).agg(F.sum("_c").alias("_t"))
    ranges = ranges.withColumns({"_n": F.sum("_t").over(group), "_from": F.sum("_t").over(group.orderBy("_part")) - F.col("_t")})
    places = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]

    def among(first: Column, last: Column) -> Column:
        """Whether one of the places has a neighbour from first to last."""
        return reduce(Column.__or__, [F.floor(at).between(first, last) | F.ceil(at).between(first, last) for at in places])

    ranges = ranges.filter(among(F.col("_from"), F.col("_from") + F.col("_t") - 1))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"r.{g}")) for g in by]
    near = cells.alias("c").join(ranges.alias("r"), [F.col("c._part") == F.col("r._part"), *same]).select("c.*", "r._n", "r._from")
    last = F.col("_from") - 1 + F.sum("_c").over(W.partitionBy("_part", *by).orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c") + 1).filter(among(F.col("_first"), F.col("_last")))
    held = lambda place: F.when(place.between(F.col("_first"), F.col("_last")), F.col("_x"))
    # by now a group has at most two rows for each probability
    ends = near.groupBy(*by).agg(*[F.max(held(end(at))).alias(f"_{i}{n}") for i, at in enumerate(places) for n, end in (("a", F.floor), ("b", F.ceil))], F.max("_n").alias("_n"))

    def between(i: int, at: Column) -> Column:
        a, b = F.col(f"_{i}a"), F.col(f"_{i}b")
        return F.when(a == b, a).otherwise((F.floor(at) + 1 - at) * a + (at - F.floor(at)) * b)

    found = F.array(*[between(i, at) for i, at in enumerate(places)])
    return ends.select(*by, found.alias(out) if by else F.when(F.col("_n").isNotNull(), found).alias(out))
