"""Helpers shared by the training-data operators: text slices, words, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in work arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: Fixed value: bytes that separate words. All other bytes (0-9, A-Z, a-z, 0x80 and over) belong to words.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

#: Byte -> lower-cased byte, separators -> space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SEPARATORS] = 32


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where spark.checkpoint.dir is unset and all runs on this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and sc.getCheckpointDir():
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found


def absent(df: DataFrame, *names: str) -> None:
    """ValueError if df has one of the columns that are to be added (names match without regard to case)."""
    clash = {n.lower() for n in names} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the table has columns of the names to be added: {sorted(clash)}")


def spare(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and keeps expensive columns."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> list:
    """At most ``rows`` rows of df on the driver, those of the smallest hashes of the keys.

    The rows are counted first, so that no task sends more than its share of about 1.3 times as many.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    some = df.withColumn("_h", h).filter(F.col("_h") < int(min(1.0, 1.3 * rows / max(n, 1)) * (1 << 30)))
    found = some.limit(3 * rows).collect()  # the bound holds for tables of one repeated row too
    return sorted(found, key=lambda r: (r["_h"], *[str(r[k]) for k in keys]))[:rows]


def slices(batch: pa.RecordBatch, column: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about limit bytes of text; each row is whole."""
    n = batch.num_rows
    if n == 0:
        return
    text = batch.column(column)
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    ends = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + n + 1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows end to end, and the n + 1 offsets; null is empty."""
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:
        rows = [x or "" for x in column.to_pylist()]
        raw = [x.encode() for x in rows]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), ends
    return data[ends[0] : ends[-1]], ends - ends[0]


def spaced_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of each row as `\\0 w1 w2 ... wn ` in one array; starts of the rows there.

    A row without words is `\\0 `. Each row begins with byte 0, which no word holds.
    """
    folded = FOLD[data]
    if len(ends) < 2:
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    # before the first row: 0, space; between rows: space, 0, space; after the last: space
    spread = np.insert(folded, np.repeat(ends, 3)[1:-2], np.tile(np.array([0, 32, 32], np.uint8), len(ends) - 1))
    space = spread == 32
    keep = np.ones(len(spread), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = spread[keep]
    return out, np.flatnonzero(out == 0)
