"""Packing of documents into fixed-length sequences along a space-filling curve.

Every document becomes token ids (and an end id). Its hashed bag of ids is projected to a few
dimensions, the Hilbert key of that point orders the documents, and the documents are laid end to
end along the curve and cut every ``length`` ids, so neighbours share sequences and only the last
sequence has padding.

The ids are written once to the shared folder. The order needs only a few numbers per document: they
are range-sorted by (key, hash, row), so equal texts spread over partitions; totals per partition and
running sums within them give each document its place in the whole stream. The places go back to the
ids by a join on the row number, which is even, and every document cuts its own pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.llm.common import materialise, slices

LENGTH = 1024
END_ID = 0
#: Counters of the hashed bag of ids, dimensions of its projection, bits of each in the key.
BUCKETS, DIMENSIONS, BITS = 256, 3, 16


def default_ranks() -> str:
    """Path of the byte-level BPE vocabulary of 50,257 ids, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(ranks_file: str):
    """Text -> ids. The same ids as the library tokenizers gives with the .json form of the vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = "<|endoftext|>"
    coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})

    def encode(text: str) -> list[int]:
        return coding.encode(text, allowed_special={end}) if end in text else coding.encode_ordinary(text)

    return encode


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of whole numbers under 2**bits (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    k = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(k):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, k):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[k - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(k):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@lru_cache(maxsize=2)
def _projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def curve_keys(ids: np.ndarray, counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Hilbert keys of documents, given their ids end to end."""
    bucket = ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    bag = np.bincount(row * BUCKETS + bucket, minlength=len(counts) * BUCKETS).reshape(len(counts), BUCKETS)
    bag = np.sqrt(bag)
    bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-9)
    point = bag @ _projection(seed)
    grid = np.clip((point + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(grid)


def tokenise(docs: DataFrame, doc_id: str, text: str, ranks_file: str, end_id: int | None) -> DataFrame:
    """doc_id, n (ids with the end id), ids (little-endian unsigned 32-bit), key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file)
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            for part in slices(batch, 1):
                rows = [np.array(encode(t or "") + tail, "<u4") for t in part.column(1).to_pylist()]
                counts = np.array([len(r) for r in rows])
                keys = curve_keys(np.concatenate(rows), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(keys, pa.int64())], ["doc_id", "n", "ids", "key"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n long, ids binary, key long")


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    ranks_file: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Every row of docs is packed, repeated rows and equal
    ids too; ties along the curve are broken by a hash of doc_id, then by row. Other columns of docs
    are not read. An empty table gives no rows. Writes two tables to the shared folder.
    """
    rows = tokenise(docs, doc_id, text, ranks_file or default_ranks(), end_id)
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "ids")
    order = ["key", "tie", "uid"]
    light = rows.select("uid", "key", F.xxhash64("doc_id").alias("tie"), "n").repartitionByRange(*order)
    light = materialise(light.withColumn("part", F.spark_partition_id()), "curve")
    totals = light.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each partition
    totals = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    running = F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    places = light.join(F.broadcast(totals), "part").select("uid", (F.col("base") + running).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(1).to_pylist()
                n = np.array([len(x) // 4 for x in ids], np.int64)
                at = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                pieces = np.where(n > 0, (at + n - 1) // length - at // length + 1, 0)
                doc = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = at[doc] // length + nth
                begin = np.maximum(sequence * length, at[doc])
                size = np.minimum((sequence + 1) * length, at[doc] + n[doc]) - begin
                start = begin - at[doc]
                own = [ids[d][s * 4 : (s + c) * 4] for d, s, c in zip(doc.tolist(), start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size)), pa.array(own, pa.binary()), *(pa.array(x, pa.int64()) for x in (n[doc], sequence, begin - sequence * length))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.select("uid", "doc_id", "ids").join(places.hint("shuffle_hash"), "uid").select("doc_id", "ids", "at")
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def crc32(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return crc32(pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def piece_crc32(ids: list[int]) -> int:
    """The checksum of a piece, in plain Python."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
