"""Fill-in-middle transformation: a text is cut at two of its token boundaries and its parts change places.

The boundaries of a text (code points before them) are a compressed set: containers of 2**16 offsets,
each as sorted array, as bitmap or as runs, whichever takes least room, with the number of offsets
before each container. The end of the k-th token is found by a search over those numbers and a select
within one container, so a very long text is never listed token by token.

Boundaries of many texts are found at once over their bytes. Each row by itself: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent, slices, text_bytes

#: Marks of prefix, suffix and middle in the output.
MARKERS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and percent of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80

#: Fixed value: white space of the token rule.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

CONTAINER = 1 << 16


class BoundarySet:
    """Rising offsets in array, bitmap and run containers; ``select`` gives the k-th one."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        starts = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(offsets) else np.empty(0, np.int64)
        self.keys, self.before = high[starts], np.append(starts, len(offsets))
        self.containers = [self._packed(offsets[a:b] - (k << 16)) for k, a, b in zip(self.keys.tolist(), self.before[:-1].tolist(), self.before[1:].tolist())]

    @staticmethod
    def _packed(low: np.ndarray) -> tuple:
        breaks = np.flatnonzero(low[1:] != low[:-1] + 1) + 1
        if 4 * (len(breaks) + 1) < min(2 * len(low), CONTAINER // 8):
            first = np.append(0, breaks)
            return "runs", low[first].astype(np.uint16), first.astype(np.uint32)  # first offset of each run, and offsets before it
        if 2 * len(low) <= CONTAINER // 8:
            return "array", low.astype(np.uint16)
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return "bitmap", words, np.cumsum(np.bitwise_count(words), dtype=np.uint32)  # words, and offsets up to each

    def __len__(self) -> int:
        return int(self.before[-1])

    def kinds(self) -> list[str]:
        return [c[0] for c in self.containers]

    def select(self, k: int) -> int:
        """The offset that has k smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.before, k, "right")) - 1
        k -= int(self.before[i])
        kind, data, *more = self.containers[i]
        if kind == "array":
            low = int(data[k])
        elif kind == "runs":
            run = int(np.searchsorted(more[0], k, "right")) - 1
            low = int(data[run]) + k - int(more[0][run])
        else:
            word = int(np.searchsorted(more[0], k, "right"))
            k -= int(more[0][word - 1]) if word else 0
            low = 64 * word + int(np.flatnonzero(np.unpackbits(data[word : word + 1].view(np.uint8), bitorder="little"))[k])
        return (int(self.keys[i]) << 16) + low


def boundaries(data: np.ndarray, ends: np.ndarray, unit: str = "token") -> Iterator[BoundarySet]:
    """Of each row of UTF-8 bytes the ends of its units, in code points.

    A token is white space and what follows up to the next white space; white space at the end is a
    token. With unit "character" each code point is a unit.
    """
    lead = (data & 0xC0) != 0x80
    points = np.append(0, np.cumsum(lead))  # code points before each byte
    last = np.zeros(len(data), bool)
    last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    if unit == "character":
        stop = np.append(lead[1:], True)[: len(data)]
    else:
        blank = BLANK[data]
        stop = ~blank
        stop[:-1] &= blank[1:] | last[:-1]
        stop |= blank & last
    at = np.flatnonzero(stop)
    of = np.searchsorted(at, ends)
    offsets = points[at + 1]
    for i in range(len(ends) - 1):
        yield BoundarySet(offsets[of[i] : of[i + 1]] - points[ends[i]])


def _checked(markers: tuple[str, str, str]) -> None:
    """ValueError where a marker could be seen across its edge, so that a text couldn't be told from it."""
    for a in markers:
        for b in markers:
            if not a or (a is not b and a in b) or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError(f"markers must not be empty or overlap: {markers}")


def transformed(
    docs: DataFrame, text: str = "text", key: str = "doc_id", found: str = "fim", seed: int = 42, rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS, unit: str = "token",
) -> DataFrame:
    """All columns of docs and a struct ``found``: n, form, prefix_chars, middle_chars, output.

    Of the hex SHA-256 of ``seed:key`` four groups of 8 digits are drawn: the first two, modulo n + 1,
    are the two cuts in tokens (a text may lose its prefix, middle or suffix); the third, modulo 100,
    must be under rate for a change; the fourth chooses suffix-prefix-middle (spm) or
    prefix-suffix-middle (psm). A null key is an empty one, and rows of equal keys draw alike. A null
    text is empty; an empty text and one that holds a marker stay as they are (plain), with null
    lengths. Each row is cut whole and by itself; an empty table gives no rows. ``found`` must not be
    a column of docs (ValueError).
    """
    absent(docs, found)
    _checked(markers)
    columns, place = list(docs.columns), docs.columns.index(text)
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(place)
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["row", "draw", "text"])
            for part in slices(batch, 2):
                out: dict[str, list] = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
                for t, draw, ends in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), boundaries(*text_bytes(part.column(2)), unit)):
                    t, n = t or "", len(ends)
                    h = [int(x, 16) for x in (draw[:8], draw[8:16], draw[16:24], draw[24:32])]
                    form, a, b, whole = "plain", None, None, t
                    if t and h[2] % 100 < rate and not any(x in t for x in markers):
                        form = "spm" if h[3] % 100 < suffix_first else "psm"
                        a, b = (ends.select(k - 1) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                        whole = f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}" if form == "spm" else f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"
                    for k, v in zip(out, (n, form, a, None if b is None else b - a, whole)):
                        out[k].append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                value = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["row", "found"])

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), draw.alias("draw"))
    kind = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
    made = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found {kind}")
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of a form was made of. Null where one of them is null."""
    p, s, m = markers
    middle, front = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    first = lambda mark, start: F.substring(F.substring_index(front, mark, 1), len(start) + 1, 2**31 - 1)
    second = lambda mark: F.substring_index(front, mark, -1)
    spm, psm = F.concat(second(p), middle, first(p, s)), F.concat(first(s, p), middle, second(s))
    return F.when(form == "spm", spm).when(form == "psm", psm).when(form == "plain", output)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its form, the lengths of its parts, and digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = transformed(docs).select("doc_id", "fim.*")
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+') AS units,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS x, coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS y, coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE x || y || z END) AS restored_sha256 FROM p
"""
