"""Token counts that follow edits.

The pre-tokens of a document lie in the leaves of a segment tree whose nodes hold characters and
tokens. An edit finds its leaf by characters, splits again only the stretch from two pre-tokens
before the edit to the first old boundary that the new split meets after it, counts the new
pre-tokens, and updates the sums on the leaf's way to the root. The split reads left to right and a
pre-token depends on nothing before it, so meeting an old boundary proves that the rest is as it was.

Documents are independent: one pass, no shuffle; counts of pre-tokens are remembered per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent, slices
from trafficwarden.llm.packing import default_ranks, encoder

#: Pre-tokens in a new leaf, and counts that a task remembers.
LEAF, REMEMBERED = 64, 500_000


class EditedCount:
    """The pre-tokens of one text as a segment tree of (characters, tokens)."""

    def __init__(self, text: str, split: Callable[[str], list[str]], count: Callable[[str], int]):
        self.split, self.count, self.recounted = split, count, 0
        pieces = split(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.base = 1
        while self.base < len(self.leaves):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.counts = [[count(p) for p in leaf] for leaf in self.leaves]
        for i in range(len(self.leaves)):
            self._leaf(i)
        for n in range(self.base - 1, 0, -1):
            self._node(n)

    def _leaf(self, i: int) -> None:
        self.chars[self.base + i], self.tokens[self.base + i] = sum(map(len, self.leaves[i])), sum(self.counts[i])

    def _node(self, n: int) -> None:
        self.chars[n], self.tokens[n] = self.chars[2 * n] + self.chars[2 * n + 1], self.tokens[2 * n] + self.tokens[2 * n + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def pieces(self) -> int:
        return sum(map(len, self.leaves))

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, pre-token in it, and its first character, of the pre-token that holds character at (the last one at the end)."""
        n, start = 1, 0
        while n < self.base:
            n *= 2
            if at >= start + self.chars[n] and self.chars[n + 1]:
                start += self.chars[n]
                n += 1
        leaf = n - self.base
        for j, p in enumerate(self.leaves[leaf]):
            if at < start + len(p) or j == len(self.leaves[leaf]) - 1:
                return leaf, j, start
            start += len(p)
        return leaf, 0, start

    def _walk(self, leaf: int, j: int) -> Iterator[tuple[int, int, str]]:
        """Pre-tokens from one on: leaf, place in it, text."""
        while leaf < len(self.leaves):
            for k in range(j, len(self.leaves[leaf])):
                yield leaf, k, self.leaves[leaf][k]
            leaf, j = leaf + 1, 0

    def apply(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end (exclusive) by new; bounds beyond the text are its end."""
        size = self.chars[1]
        start, end = min(max(start, 0), size), min(max(end, start, 0), size)
        leaf, j, at = self._find(max(start - 1, 0))
        for _ in range(2):  # what the split looks ahead at
            while j == 0 and leaf > 0 and not self.leaves[leaf - 1]:
                leaf -= 1
            if j == 0 and leaf == 0:
                break
            leaf, j = (leaf, j - 1) if j else (leaf - 1, len(self.leaves[leaf - 1]) - 1)
            at -= len(self.leaves[leaf][j])
        walk = self._walk(leaf, j)
        old, place, after = [], at, []
        for i, k, p in walk:  # the stretch that the edit touches
            if place > end:
                after.append((i, k, p))
                break
            old.append((i, k))
            after.append((i, k, p)) if place >= end else None
            place += len(p)
        text = "".join(self.leaves[i][k] for i, k in old)
        fresh = text[: start - at] + new + text[end - at :]
        boundary = len(fresh)  # where an old pre-token starts, in the new stretch
        follow = [(i, k, p) for i, k, p in after if (i, k) not in set(old)]
        while True:
            ahead = "".join(p for *_, p in follow)
            pieces, met, kept = self.split(fresh + ahead), 0, []
            starts = {boundary}
            edge = boundary
            for *_, p in follow:
                edge += len(p)
                starts.add(edge)
            for p in pieces:
                if met >= boundary and met in starts:
                    break
                kept.append(p)
                met += len(p)
            complete = met < len(fresh) + len(ahead)  # a boundary was met before the end, with text ahead of it
            more = [] if complete else [x for _, x in zip(range(8), walk)]
            if complete or not more:
                break
            follow += more
        used = met - boundary
        gone = list(old)
        for i, k, p in follow:
            if used <= 0:
                break
            gone.append((i, k))
            used -= len(p)
        counts = [self.count(p) for p in kept]
        self.recounted += len(kept)
        self._replace(gone, leaf, j, kept, counts)

    def _replace(self, gone: list[tuple[int, int]], leaf: int, j: int, pieces: list[str], counts: list[int]) -> None:
        by: dict[int, list[int]] = {}
        for i, k in gone:
            by.setdefault(i, []).append(k)
        for i, ks in by.items():
            del self.leaves[i][ks[0] : ks[-1] + 1], self.counts[i][ks[0] : ks[-1] + 1]
        self.leaves[leaf][j:j], self.counts[leaf][j:j] = pieces, counts
        for i in {leaf, *by}:
            self._leaf(i)
            n = (self.base + i) // 2
            while n:
                self._node(n)
                n //= 2


def splitter() -> Callable[[str], list[str]]:
    """The pre-token split of the vocabulary; the pieces of a text are the whole text."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def counted(docs: DataFrame, edits: Column, text: str = "text", found: str = "tokens", ranks_file: str | None = None) -> DataFrame:
    """All columns of docs and a struct ``found``: pieces, tokens, edits, tokens_after, recounted.

    edits is an array of (start, end, text): characters of the text as the edits before have left it.
    Null edits are none. A null text is empty. tokens counts ordinary text (no special ids);
    recounted is the number of pre-tokens that the edits made the counter look at again. Each row is
    counted whole and by itself. ``found`` must not be a column of docs (ValueError).
    """
    absent(docs, found)
    columns = list(docs.columns)
    path = ranks_file or default_ranks()
    kinds = ["pieces", "tokens", "edits", "tokens_after", "recounted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, encode, known = splitter(), encoder(path), {}

        def count(piece: str) -> int:
            n = known.get(piece)
            if n is None:
                n = len(encode(piece))
                if len(known) < REMEMBERED:
                    known[piece] = n
            return n

        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for t, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tree = EditedCount(t or "", split, count)
                    pieces, before = tree.pieces(), tree.total()
                    for e in changes or []:
                        tree.apply(e["start"], e["end"], e["text"] or "")
                    rows.append((pieces, before, len(changes or []), tree.total(), tree.recounted))
                value = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["row", "found"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"), edits.alias("edits"))
    out = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found struct<{','.join(f'{k}:bigint' for k in kinds)}>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


def sample_edits(text: Column) -> Column:
    """Three edits of a text: its first long number is blanked, a note goes into the middle, the last twelve characters go."""
    t = F.coalesce(text, F.lit(""))
    number, size = F.regexp_extract(t, "[0-9]{4,}", 0), F.length(t)
    at = F.length(F.regexp_extract(t, "(?s)^(.*?)[0-9]{4,}", 1))
    edit = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("text"))
    blanked = F.when(F.length(number) > 0, edit(at, at + F.length(number), "[number]"))
    after = size + F.when(F.length(number) > 0, 8 - F.length(number)).otherwise(0)
    middle = F.floor(after / 2)
    return F.array_compact(F.array(blanked, edit(middle, middle, " (edited) "), edit(F.greatest(after + 10 - 12, F.lit(0)), after + 10, "")))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after three edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = counted(docs, sample_edits(F.col("text")))
    return out.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("tokens.pieces").alias("n_pieces"), F.col("tokens.tokens").alias("n_tokens"), F.col("tokens.edits").alias("n_edits"), F.col("tokens.tokens_after").alias("n_tokens_edited"), F.col("tokens.recounted").alias("n_recounted"))
