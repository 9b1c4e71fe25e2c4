"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every run of ``window`` consecutive words of a benchmark item is a test string (an item of fewer
words is one). The strings are searched in the lower-cased words of every whole document: a shift
table over blocks of bytes tells how far the search may jump, a shift of nought leads to the bucket
of strings with that suffix block, and a direct comparison confirms. The jumps of many stretches of
text are made at once, in numpy arrays, inside ``mapInArrow``; there is no shuffle.

Benchmarks are searched in blocks of about ``block_bytes`` of item text, dealt out by a running sum of
bytes; a longer item is cut into parts that share ``window`` - 1 words, so that no window is lost. The first pass gives a row for
every document; each further one runs when the last is done, over the same written rows, and gives
the documents that it hits alone, which are joined at the end. So what the driver sends, and the tables
that a worker builds once and keeps, are those of one block however large the benchmark is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent, materialise, slices, spaced_words, text_bytes
from trafficwarden.operators.order import running_sum

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Words of a text start at this many stretches of bytes that are searched side by side.
LANE = 2048
#: A shift table has at most two to this power slots of a byte.
MAX_BITS = 25

FOUND = "struct<n_words:bigint,hits:array<struct<first:bigint,last:bigint>>,items:array<string>>"
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _words(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    data, _ = spaced_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return data[1:].tobytes().split()


def cut(text: str | None, window: int, limit: int) -> list[str]:
    """The words of an item in parts of about limit bytes, each of a window at least (but for shorter items); every window lies in one part."""
    words, out, first = _words(text), [], 0
    while first < len(words):
        last, size = first, 0
        while last < len(words) and (size < limit or last - first < window):
            size += len(words[last]) + 1
            last += 1
        out.append(b" ".join(words[first:last]).decode())
        if last == len(words):
            break
        first = last - window + 1
    return out


def dealt(texts: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, item, text) and the number of blocks, of at most one and a half times block_bytes (and a window) each, whatever the ids."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                for part in cut(text, window, block_bytes // 2):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([part], pa.string())], ["item", "text"])

    rows = texts.mapInArrow(parts, "item string, text string").withColumn("uid", F.monotonically_increasing_id())
    size = F.octet_length("text").cast("long")
    summed = running_sum(materialise(rows, "parts"), ["uid"], size, "until")
    out = materialise(summed.select(F.floor((F.col("until") - size) / block_bytes).alias("block"), "item", "text"), "blocks")
    return out, (out.agg(F.max("block")).first()[0] or 0) + 1


def test_strings(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[bytes, tuple[int, list[str]]]:
    """String (with its spaces) -> its number of words and the items that hold it; an item of no id isn't listed."""
    out: dict[bytes, tuple[int, list[str]]] = {}
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            _, of = out.setdefault(b" " + b" ".join(part) + b" ", (len(part), []))
            if item is not None and (not of or of[-1] != item):
                of.append(item)
    return out


class WuManber:
    """Tables for strings of one class of lengths: at least ``least`` bytes, blocks of ``block`` bytes.

    The shift table has about eight slots for each different block, so that few others share a slot.
    """

    def __init__(self, strings: list[bytes]):
        self.least = min(min(map(len, strings)), 128)
        self.block = min(8, 3 if self.least < 24 else 8, self.least)
        heads = np.frombuffer(b"".join(s[: self.least] for s in strings), np.uint8).reshape(len(strings), self.least)
        self.bits = MAX_BITS
        seen, keys = np.zeros(1 << MAX_BITS, bool), np.empty(0, np.uint64)
        for end in range(self.block, self.least + 1):
            keys = self._key(heads[:, end - self.block : end])
            seen[self._slot(keys)] = True
        self.bits = min(MAX_BITS, max(16, (8 * int(seen.sum())).bit_length()))
        self.jump = np.full(1 << self.bits, self.least - self.block + 1, np.uint8)
        for end in range(self.block, self.least + 1):  # ever smaller jumps: the last one written holds
            self.jump[self._slot(self._key(heads[:, end - self.block : end]))] = self.least - end
        order = np.argsort(keys, kind="stable")
        self.suffix = keys[order]
        self.strings = [strings[i] for i in order]
        self.prefix = np.ascontiguousarray(self._key(heads[:, : self.block]))[order]

    def _key(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 8), np.uint8)
        out[:, : rows.shape[1]] = rows
        return out.view("<u8").ravel()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _at(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._key(data[at[:, None] + np.arange(self.block)])

    def search(self, data: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(place, string) of all occurrences in data."""
        size = len(data) - self.least + 1
        if size <= 0:
            return
        at = np.arange(0, size, LANE)
        stop = np.minimum(at + LANE, size)
        back = self.least - self.block
        found = []
        while len(at):
            jump = self.jump[self._slot(self._at(data, at + back))].astype(np.int64)
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return
        at = np.sort(np.concatenate(found))
        suffix, prefix = self._at(data, at + back), self._at(data, at)
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        for i in np.flatnonzero(high > low):
            place, head = int(at[i]), prefix[i]
            for j in range(low[i], high[i]):
                if self.prefix[j] == head:
                    string = self.strings[j]
                    if data[place : place + len(string)].tobytes() == string:
                        yield place, string


def searchers(strings: dict[bytes, tuple[int, list[str]]]) -> list[WuManber]:
    """One set of tables for the long strings and others for the few short ones, which would spoil the jumps."""
    classes = ([s for s in strings if len(s) >= 32], [s for s in strings if 12 <= len(s) < 32], [s for s in strings if len(s) < 12])
    return [WuManber(c) for c in classes if c]


def _scan(strings: dict[bytes, tuple[int, list[str]]], text: pa.Array, searches: list[WuManber]) -> list[dict]:
    data, starts = spaced_words(*text_bytes(text))
    gaps = np.flatnonzero(data == 32)
    first = np.searchsorted(gaps, starts)
    counts = np.diff(np.append(first, len(gaps))) - 1
    out = [{"n_words": int(c), "hits": [], "items": []} for c in counts]
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for search in searches:
        for place, string in search.search(data):
            row = int(np.searchsorted(starts, place, "right")) - 1
            word = int(np.searchsorted(gaps, place)) - int(first[row])
            n, of = strings[string]
            hits.setdefault(row, []).append((word, word + n - 1))
            items.setdefault(row, set()).update(of)
    for row, spans in hits.items():
        out[row]["hits"], out[row]["items"] = merged(spans), sorted(items[row])
    return out


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Union of runs of words, as disjoint runs in order."""
    out: list[dict] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, found: str = "found",
) -> DataFrame:
    """All columns of docs and a struct ``found``: n_words, hits (disjoint runs of hit words, from 0), items (sorted).

    A null or empty text has no words and no hits; an item without words is never found; items with
    equal texts are all found; the words of an item of a null id are hit, but it isn't listed; an empty
    benchmark finds nothing. Repeated rows are judged each. ``found`` must not be a column of docs
    (ValueError). No shuffle of documents where the benchmark is one block.
    """
    absent(docs, found)
    spark: SparkSession = docs.sparkSession
    texts = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    # an item counts for its id and two fields too, so that a block of many empty ones is bounded as well
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    dealt_out, blocks = (texts, 1) if size <= block_bytes else dealt(texts, window, block_bytes)
    columns = list(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None)

    def sent(b: int):
        part = texts if dealt_out is texts else dealt_out.filter(F.col("block") == b)
        return spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])

    if blocks == 1:
        raw = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
        out = raw.mapInArrow(_pass(sent(0), window, "row"), f"row {raw.schema['row'].dataType.simpleString()}, found {FOUND}")
    else:
        raw = materialise(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("uid")), "searched")
        more = []
        for b in range(blocks):
            shared = sent(b)
            # the first pass has a row for each document, the others for those that they hit
            each = raw.select("uid", "text").mapInArrow(_pass(shared, window, "uid", b > 0), f"uid long, found {FOUND}")
            more.append(materialise(each, "found"))
            shared.destroy()
        hits = more[0]
        for other in more[1:]:
            hits = hits.unionAll(other)
        parts = hits.groupBy("uid").agg(F.collect_list("found").alias("parts"))  # at most one of each block
        merged_ = raw.select("uid", "row").join(parts, "uid").select("row", "parts")
        out = merged_.mapInArrow(_together, f"row {raw.schema['row'].dataType.simpleString()}, found {FOUND}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


#: The tables of the last block that this worker searched.
_TABLES: dict[str, tuple] = {}


def _pass(shared, window: int, key: str, hits_only: bool = False):
    """The search of one block: (key, text) to (key, found)."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TABLES:
            _TABLES.clear()
            strings = test_strings(shared.value, window)
            _TABLES[name] = strings, searchers(strings)
        for batch in batches:
            for part in slices(batch, "text"):
                found = _scan(_TABLES[name][0], part.column("text"), _TABLES[name][1])
                if hits_only:
                    on = [i for i, f in enumerate(found) if f["hits"]]
                    part, found = part.take(pa.array(on, pa.int64())), [found[i] for i in on]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found, _FOUND)], [key, "found"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for parts in batch.column("parts").to_pylist():
            hits = merged([(h["first"], h["last"]) for p in parts for h in p["hits"]])
            found.append({"n_words": max(p["n_words"] for p in parts), "hits": hits, "items": sorted({i for p in parts for i in p["items"]})})
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, _FOUND)], ["row", "found"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark passages in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The same in SQL: the windows of every item and every document meet in a hash join.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS s FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT row_id, n, unnest(range(len(w) - n + 1)) AS i, w FROM d, lens WHERE len(w) >= n),
h AS (SELECT dw.row_id, i, p.n, p.item_id FROM dw JOIN p ON p.n = dw.n AND array_to_string(dw.w[i + 1 : i + dw.n], ' ') = p.s),
hw AS (SELECT row_id, count(DISTINCT k) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY row_id),
hi AS (SELECT row_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM h) GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (row_id) LEFT JOIN hi USING (row_id)
"""
