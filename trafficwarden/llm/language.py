"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language; the languages share sorted hash arrays of their n-grams,
with a column of finished log-probabilities (or back-off weights) per language. A text gets the
language of the lowest cross-entropy per character. A text is rejected if even that is beyond what
calibration texts of the chosen language show.

The models are fitted on a bounded sample of labelled rows: at most ``rows_per_lang`` texts a
language, each of at most ``longest`` characters, those of the smallest hashes of id and text. Every
document is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent, slices

ORDER = 5
ROWS_PER_LANG = 600
LONGEST = 50_000
#: Letters told apart; all others are one symbol.
LETTERS = 250
#: Bits per character that a text may have beyond the calibration quantile; texts of fewer symbols aren't rejected.
SLACK, QUANTILE, SHORTEST = 2.0, 0.999, 50

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts end to end, and how many each has."""
    low = [t.lower() for t in texts]
    return np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32), np.array([len(t) for t in low])


def symbols(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts end to end, each text 0 ... 0, and starts: 0 between words, 1 a rare letter, 2.. letters."""
    points, counts = code_points(texts)
    found = alphabet[points]
    starts = np.cumsum(counts) - counts
    found = np.insert(found, np.repeat(np.append(starts, len(points)), 2)[1:-1], 0)
    starts = starts + 2 * np.arange(len(starts))
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    keep[starts] = True
    at = np.cumsum(keep) - 1
    return found[keep], at[starts]


def grams(found: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol but the first of a text, 8 bits a symbol, and the text of each; before a text stands 0."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(found))))
    place = np.arange(len(found)) - starts[row]
    key = np.zeros(len(found), np.uint64)
    for back in range(order):
        part = np.zeros(len(found), np.uint64)
        part[back:] = found[: len(found) - back]
        part[place < back] = 0
        key |= part << np.uint64(8 * back)
    scored = place > 0
    return key[scored], row[scored]


class HashArray:
    """Sorted hashes of keys under 2**40, with a directory over their leading bits."""

    def __init__(self, keys: np.ndarray):
        hashes = keys * _MIX  # odd multiplier: no two keys meet
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(1, int(len(keys)).bit_length() + 2)
        self.start = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the sorted arrays, and whether it is there."""
        hashes = keys * _MIX
        at = self.start[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        low = np.flatnonzero(self.hashes[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[self.hashes[at[low]] < hashes[low]]
        return at, self.hashes[at] == hashes


class KneserNey:
    """Models of all languages, fitted on {language: texts}."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        lettered = lambda texts: any(c.isalpha() for t in texts for c in t)
        samples = {x: t for x, t in samples.items() if lettered(t)}  # a language of no letter can't be learned
        self.order, self.langs = order, sorted(samples)
        points, n = np.unique(np.concatenate([code_points(samples[x])[0] for x in self.langs] or [np.empty(0, np.uint32)]), return_counts=True)
        letter = _letters()[points]
        points, n = points[letter], n[letter]
        self.common = points[np.lexsort((points, -n))[:LETTERS]]
        self.levels: list = []
        self.limit = np.full(len(self.langs), np.inf)
        if not self.langs:
            return
        parts = {x: [v for i, v in enumerate(t) if i % 5] for x, t in samples.items()}
        fit = {x: parts[x] if len(t) >= 5 and lettered(parts[x]) else t for x, t in samples.items()}
        counts = [self._counts(fit[x]) for x in self.langs]
        flat = 1.0 / (len(self.common) + 2)
        below: tuple[HashArray, np.ndarray] | None = None
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([c[n - 1][0] for c in counts]))
            contexts = np.unique(keys >> np.uint64(8))
            prob, gamma = np.zeros((len(keys), len(self.langs))), np.ones((len(contexts), len(self.langs)))
            if below is None:
                lower = np.full(prob.shape, flat)
            else:
                at, _ = below[0].find(keys & np.uint64((1 << (8 * (n - 1))) - 1))
                lower = below[1][at]
            where = np.searchsorted(contexts, keys >> np.uint64(8))
            for i, c in enumerate(counts):
                own, times = c[n - 1]
                if not len(own):
                    prob[:, i] = lower[:, i]
                    continue
                once, twice = (times == 1).sum(), (times == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                context = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(context, times, len(contexts))
                kinds = np.bincount(context, minlength=len(contexts))
                seen = total > 0
                gamma[seen, i] = discount * kinds[seen] / total[seen]
                at = np.searchsorted(keys, own)
                prob[at, i] = (times - discount) / total[context]
                prob[:, i] += gamma[where, i] * lower[:, i]
            table, back = HashArray(keys), HashArray(contexts)
            prob = prob[table.order]
            self.levels.append((table, np.log2(prob).astype(np.float32).T.copy(), back, np.log2(gamma[back.order]).astype(np.float32).T.copy()))
            below = (table, prob)
        self.flat = np.float32(np.log2(flat))
        for i, x in enumerate(self.langs):
            bits, _, size = self.cross_entropy([v for j, v in enumerate(samples[x]) if j % 5 == 0])
            long = size >= SHORTEST
            if long.any():
                self.limit[i] = np.quantile(bits[long, i], QUANTILE) + SLACK

    def _counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of each order: as often as seen for the highest, distinct symbols before for the others."""
        key, _ = grams(*symbols(texts, self.alphabet()), self.order) if texts else (np.empty(0, np.uint64), None)
        keys, times = np.unique(key, return_counts=True)
        out = [(keys, times)]
        for n in range(self.order - 1, 0, -1):
            keys, times = np.unique(keys & np.uint64((1 << (8 * n)) - 1), return_counts=True)
            out.insert(0, (keys, times))
        return out

    def alphabet(self) -> np.ndarray:
        """Symbol of every code point."""
        out = _letters().astype(np.uint64)
        out[self.common] = np.arange(2, len(self.common) + 2)
        return out

    def cross_entropy(self, texts: list[str], alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per symbol of each text (rows) in each language, whether it has a letter, and its symbols."""
        found, starts = symbols(texts, self.alphabet() if alphabet is None else alphabet)
        key, row = grams(found, starts, self.order)
        size = np.bincount(row, minlength=len(texts))
        letters = np.bincount(row, found[np.setdiff1d(np.arange(len(found)), starts, assume_unique=True)] > 0, len(texts)) > 0 if len(row) else np.zeros(len(texts), bool)
        bits = np.zeros((len(texts), len(self.langs)))
        owed = None
        for n in range(self.order, 0, -1):
            table, prob, back, gamma = self.levels[n - 1]
            at, there = table.find(key)
            hit, own = at[there], row[there]
            for i in range(len(self.langs)):
                value = prob[i][hit] if owed is None else prob[i][hit] + owed[i][there]
                bits[:, i] -= np.bincount(own, value, len(texts))
            if there.all():
                break
            miss = ~there
            key, row = key[miss], row[miss]
            at, there = back.find(key >> np.uint64(8))
            owed = [(0 if owed is None else owed[i][miss]) + np.where(there, gamma[i][np.minimum(at, gamma.shape[1] - 1)], 0) for i in range(len(self.langs))]
            key = key & np.uint64((1 << (8 * (n - 1))) - 1)
        else:
            for i in range(len(self.langs)):
                bits[:, i] -= np.bincount(row, owed[i] + self.flat, len(texts))
        return bits / np.maximum(size, 1)[:, None], letters, size


def held_out(doc_id: Column) -> Column:
    """Documents kept from the models: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, longest: int = LONGEST) -> KneserNey:
    """Models from labelled rows that aren't held out. One aggregation, then at most 1.3 times the sample comes to the driver."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= longest))
    share = [(r.lang, min(1.0, 1.3 * rows_per_lang / r.n)) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not share:
        return KneserNey({})
    part = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("part")
    shares = F.create_map(*[F.lit(v) for pair in share for v in pair])
    chosen = known.select("lang", "text", part).filter(F.col("part") < F.element_at(shares, F.col("lang")))
    samples: dict[str, list] = {}
    for r in chosen.limit(3 * rows_per_lang * len(share)).collect():
        samples.setdefault(r.lang, []).append((r.part, r.text))
    return KneserNey({x: [t for _, t in sorted(rows)[:rows_per_lang]] for x, rows in samples.items()})


def identify(docs: DataFrame, model: KneserNey, text: str = "text", found: str = "language") -> DataFrame:
    """All columns of docs and a struct ``found``: lang, score (0 to 1), bits (per symbol, null without letters), rejected.

    lang is ``und`` and rejected is true if the text is null, empty or has no letter, or if the model
    knows no language. Ties go to the first language by name. Each row is judged by its text alone.
    ``found`` must not be a column of docs (ValueError).
    """
    absent(docs, found)
    columns = list(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        alphabet = model.alphabet()
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if not model.langs:
                    new = [("und", 0.0, None, True)] * len(texts)
                else:
                    bits, letters, size = model.cross_entropy(texts, alphabet)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(texts)), best]
                    score = 1 / np.exp2((least[:, None] - bits) * np.minimum(size, 60)[:, None]).sum(axis=1)
                    far = (least > model.limit[best]) & (size >= SHORTEST)
                    new = [(model.langs[b], float(s), float(x), bool(f)) if y else ("und", 0.0, None, True) for b, s, x, f, y in zip(best, score, least, far, letters)]
                lang, score, bits, rejected = zip(*new)
                value = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "bits", "rejected"])
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["row", "found"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    out = source.mapInArrow(run, f"row {kind}, found struct<lang:string,score:double,bits:double,rejected:boolean>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models of the labelled ones that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
