"""Personal data by a character-level bidirectional LSTM with a CRF, beside exact base patterns.

The base patterns give the base spans, by linear scans over the whole text. The model adds spans
that the patterns miss (numbers without the plus sign, cards with a typo, e-mail addresses with
spaces). It is trained in numpy on windows of a bounded sample of the documents, labelled by the base
patterns and by inserted variants, and tags every window of ``WIDTH`` characters, ``STRIDE`` apart,
that holds a digit or an at sign: all four kinds need one, so no other window can hold a span. The
spans of overlapping windows are reconciled over the whole document: the reading that lies furthest
from its window's edges wins. Base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm import lstm
from trafficwarden.llm.common import absent, hash_sample, slices

#: Fixed value: the kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
#: Bound of the sample that the model is fitted on: documents, and characters of each.
SAMPLE_ROWS, SAMPLE_LONGEST = 400, 20_000
WIDTH, STRIDE = 128, 64
HIDDEN, EPOCHS, WINDOWS, TRAINED = 16, 4, 2000, 80
#: Least mean tag probability along a span that the model may add.
SURE = 0.9

Span = tuple[int, int, str]

# The base patterns. Look-behinds keep the scans linear; a match never starts within a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# The model: symbols, tags, network, CRF.

SIGNS = " \n\t.,;:!?@+-_()[]{}<>/\\'\"=%#&*|~$"
#: 0 padding, 1 digit, 2 lower-case, 3 upper-case, 4 other letters, 5 any other sign, then the signs above.
SYMBOLS = 6 + len(SIGNS)
TAGS = 1 + 2 * len(KINDS)


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    out = np.fromiter((4 if chr(i).isalpha() else 5 for i in range(0x110000)), np.uint8, 0x110000)
    out[48:58], out[97:123], out[65:91] = 1, 2, 3
    for i, c in enumerate(SIGNS):
        out[ord(c)] = 6 + i
    return out


def symbols(text: str) -> np.ndarray:
    return _symbol_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def tags(spans: list[Span], size: int) -> np.ndarray:
    """0 outside, 1 + 2k first character of kind k, 2 + 2k the others. Of overlapping spans the first holds."""
    out = np.zeros(size, np.int64)
    for start, end, kind in spans:
        if not out[max(start, 0) : end].any():
            k = KINDS.index(kind)
            out[max(start, 0) : end] = 2 + 2 * k
            if start >= 0:
                out[start] = 1 + 2 * k
    return out


def _emit(p: lstm.Params, x: np.ndarray, keep: bool = False):
    states, kept = lstm.forward(p, p["ahead_x"][x], p["back_x"][x], None, keep)
    return states @ p["out_w"] + p["out_b"], states, kept


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _sums(p: lstm.Params, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-sums of the CRF over all taggings: up to each step, after it, and in all."""
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, len(e)):
        a[t] = _lse(a[t - 1][:, :, None] + p["move"], 1) + e[t]
    for t in range(len(e) - 2, -1, -1):
        b[t] = _lse(p["move"] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    return a, b, _lse(a[-1], 1)


def _loss(p: lstm.Params, x: np.ndarray, y: np.ndarray):
    """Negative log-likelihood of the tags under the CRF, and its gradients."""
    e, states, kept = _emit(p, x, True)
    steps, batch, _ = e.shape
    a, b, whole = _sums(p, e)
    de = np.exp(a + b - whole[:, None]).astype(np.float32)
    rows = np.arange(batch)
    for t in range(steps):
        de[t, rows, y[t]] -= 1
    dmove = np.zeros_like(p["move"])
    score = e[0, rows, y[0]].copy()
    for t in range(1, steps):
        pair = np.exp(a[t - 1][:, :, None] + p["move"] + (e[t] + b[t])[:, None, :] - whole[:, None, None])
        dmove += pair.sum(0)
        np.add.at(dmove, (y[t - 1], y[t]), -1)
        score += e[t, rows, y[t]] + p["move"][y[t - 1], y[t]]
    de /= batch
    grads, dahead, dback = lstm.backward(p, de @ p["out_w"].T, kept)
    grads |= {"out_w": np.einsum("tbh,tbk->hk", states, de), "out_b": de.sum((0, 1)), "move": (dmove / batch).astype(np.float32)}
    for name, dz in (("ahead_x", dahead), ("back_x", dback)):
        grads[name] = np.zeros_like(p[name])
        np.add.at(grads[name], x.ravel(), dz.reshape(-1, dz.shape[2]))
    return float((whole - score).mean()), grads


def _made(rng: np.random.Generator) -> tuple[str, str | None]:
    """One variant of a kind, or a look-alike that is none (kind null)."""
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda a, b: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *x: x[rng.integers(0, len(x))]
    kind = pick("email", "email", "ip", "card", "card", "phone", "phone", None, None, None)
    if kind == "email":
        at = pick("@", "@", "@", " @ ", "@ ")
        return letters(2, 9) + pick("", "." + letters(2, 6), digit(2), "." + digit(2)) + at + letters(3, 9) + pick("", digit(1)) + pick("", "." + letters(3, 8)) + "." + pick("com", "org", "net", "de", "fr"), kind
    if kind == "ip":
        return ".".join(str(rng.integers(0, 256)) for _ in range(4)), kind
    if kind == "card":
        sign = pick("", "", " ", "-")
        return sign.join(digit(4) for _ in range(4)), kind
    if kind == "phone":
        area, one, two = digit(3), digit(3), digit(4)
        return pick(f"+{digit(1)} ({area}) {one}-{two}", f"({area}) {one}-{two}", f"+{digit(2)} {area} {one} {two}", f"+{digit(1)}-{area}-{one}-{two}", f"{area}-{one}-{two}", f"+{digit(11)}"), kind
    hexed = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(8, 40)))
    return pick(hexed, f"token = \"{hexed}\"", f"password={hexed}", digit(rng.integers(1, 9)), f"{digit(4)}-{digit(2)}-{digit(2)}", f"{digit(1)}.{digit(1)}", f"v{digit(1)}.{digit(1)}.{digit(2)}", f"{digit(2)}:{digit(2)}", f"{digit(3)},{digit(2)}", f"@{letters(3, 9)}", f"{letters(2, 5)}{digit(3)}"), None


def _examples(texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags: stretches of the texts as they are, or with something inserted."""
    x, y = np.zeros((WINDOWS, TRAINED), np.int64), np.zeros((WINDOWS, TRAINED), np.int64)
    places = [(i, m.start()) for i, t in enumerate(texts) for m in TRIGGER.finditer(t)]
    for i in range(WINDOWS):
        if places and i % 3 == 0:
            doc, near = places[rng.integers(0, len(places))]
            start = max(0, near - int(rng.integers(5, TRAINED - 5)))
            text, spans = texts[doc], base_spans(texts[doc][max(0, start - 60) : start + TRAINED + 60])
            spans = [(a + max(0, start - 60) - start, b + max(0, start - 60) - start, k) for a, b, k in spans]
            spans = [s for s in spans if s[1] > 0 and s[0] < TRAINED]
            part = text[start : start + TRAINED]
        else:
            text = texts[rng.integers(0, len(texts))] if texts else ""
            start = int(rng.integers(0, max(1, len(text) - TRAINED)))
            part = re.sub(r"[0-9@]", "", text[start : start + TRAINED])
            made, kind = _made(rng)
            at = int(rng.integers(0, max(1, min(len(part), TRAINED - len(made)))))
            before, after = part[:at].rstrip() + " ", part[at:].lstrip()
            if rng.integers(0, 8) == 0:
                before = ""
            part = before + made + ("" if rng.integers(0, 6) == 0 else " ") + after
            spans = [(len(before), len(before) + len(made), kind)] if kind else []
            part = part[:TRAINED]
        x[i, : len(part)] = symbols(part)
        y[i, : len(part)] = tags([(a, min(b, len(part)), k) for a, b, k in spans], TRAINED)[: len(part)]
    return x, y


def train(texts: list[str], seed: int = 11, hidden: int = HIDDEN, epochs: int = EPOCHS) -> lstm.Params:
    """Parameters of the network, fitted on windows of the texts."""
    rng = np.random.default_rng(seed)
    x, y = _examples(texts, rng)
    p = lstm.new_params(hidden, rng)
    for name, shape in (("ahead_x", (SYMBOLS, 4 * hidden)), ("back_x", (SYMBOLS, 4 * hidden)), ("out_w", (2 * hidden, TAGS))):
        p[name] = (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p["out_b"], p["move"] = np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)
    adam = lstm.Adam(p, 0.02)
    for epoch in range(epochs):
        adam.rate = 0.02 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for i in range(0, len(x), 48):
            some = order[i : i + 48]
            adam.update(_loss(p, x[some].T, y[some].T)[1])
    return p


def _viterbi(p: lstm.Params, e: np.ndarray) -> np.ndarray:
    """The best tags (batch, steps)."""
    steps, batch, n = e.shape
    score, back = e[0], np.empty((steps, batch, n), np.int8)
    for t in range(1, steps):
        options = score[:, :, None] + p["move"]
        back[t] = options.argmax(1)
        score = options.max(1) + e[t]
    out = np.empty((batch, steps), np.int64)
    out[:, -1] = score.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t, rows, out[:, t]]
    return out


def _plausible(text: str, kind: str) -> bool:
    """What a span must hold to be of the kind at all."""
    digits = len(_digits(text))
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[A-Za-z]{2,}", text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}([. ]+[0-9]{1,3}){3}", text))
    if kind == "card":
        return 13 <= digits <= 19 and bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", text))
    return 7 <= digits <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text)) and (text[0] in "+(" or not text.isdigit())


def _rejoined(parts: list[tuple[int, int, str, float, bool, bool]]) -> Iterator[tuple[int, int, str, float]]:
    """Spans (start, end, kind, mean) from overlapping readings of neighbouring windows that reach an edge; those whose ends no window sees go."""
    for kind in sorted({p[2] for p in parts}):
        run: list[tuple[int, int, str, float, bool, bool]] = []
        for part in [*sorted(p for p in parts if p[2] == kind), None]:
            if run and (part is None or part[0] > max(p[1] for p in run)):
                begin, end = min(p[0] for p in run), max(p[1] for p in run)
                if any(p[0] == begin and not p[4] for p in run) and any(p[1] == end and not p[5] for p in run):
                    yield begin, end, kind, sum(p[3] * (p[1] - p[0]) for p in run) / sum(p[1] - p[0] for p in run)
                run = []
            if part is not None:
                run.append(part)


def model_spans(p: lstm.Params, texts: list[str], at_once: int = 1024) -> list[list[Span]]:
    """Spans that the model reads in each whole text, reconciled over its overlapping windows."""
    coded, where = {}, []
    for i, t in enumerate(texts):
        found = sorted({k for m in TRIGGER.finditer(t) for k in (m.start() // STRIDE - 1, m.start() // STRIDE) if k >= 0})
        if found:
            coded[i] = symbols(t)
            where += [(i, k * STRIDE) for k in found]
    readings: dict[int, list[tuple[int, float, int, int, str]]] = {}
    cut: dict[int, list[tuple[int, int, str, float, bool, bool]]] = {}
    for j in range(0, len(where), at_once):
        some = where[j : j + at_once]
        x = np.zeros((len(some), WIDTH), np.int64)
        for r, (i, start) in enumerate(some):
            part = coded[i][start : start + WIDTH]
            x[r, : len(part)] = part
        e, *_ = _emit(p, x.T)
        best = _viterbi(p, e)
        before, after, whole = _sums(p, e)
        sure = np.exp(before + after - whole[:, None])  # probability of each tag at each step
        for r in np.flatnonzero(best.any(axis=1)):
            i, start = some[r]
            size = min(WIDTH, len(texts[i]) - start)
            t = 0
            while t < size:
                tag = best[r, t]
                if tag == 0:
                    t += 1
                    continue
                kind, first = (tag - 1) // 2, t
                t += 1
                while t < size and best[r, t] == 2 + 2 * kind:
                    t += 1
                left = WIDTH if start == 0 else first
                right = WIDTH if start + size == len(texts[i]) else size - t
                mean = float(sure[range(first, t), r, best[r, first:t]].mean())
                if min(left, right) == 0:
                    cut.setdefault(i, []).append((start + first, start + t, KINDS[kind], mean, left == 0, right == 0))
                else:
                    readings.setdefault(i, []).append((min(left, right), mean, start + first, start + t, KINDS[kind]))
    for i, parts in cut.items():  # a span that reaches beyond its window is read in parts
        for a, b, kind, mean in _rejoined(parts):
            readings.setdefault(i, []).append((1, mean, a, b, kind))
    out: list[list[Span]] = [[] for _ in texts]
    for i, found in readings.items():
        taken: list[Span] = []
        for _, mean, a, b, kind in sorted(found, key=lambda v: (-v[0], -v[1], v[2])):
            if all(b <= c or d <= a for c, d, _ in taken):
                taken.append((a, b, kind))
                if mean >= SURE and _plausible(texts[i][a:b], kind):
                    out[i].append((a, b, kind))
    return out


def all_spans(p: lstm.Params, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and the base spans with those of the model that touch none of them."""
    out = []
    for text, more in zip(texts, model_spans(p, texts)):
        base = base_spans(text)
        out.append((base, in_order(base + [m for m in more if all(m[1] <= s[0] or s[1] <= m[0] for s in base)])))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, last, covered = [], 0, 0
    for start, end, kind in spans:
        if start >= covered:
            out += [text[last:start], f"[{kind.upper()}]"]
        covered = last = max(covered, end)
    return "".join(out) + text[last:]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> lstm.Params:
    """The model, fitted on at most ``rows`` documents of at most ``longest`` characters that hold a digit or an at sign, by the hash of the id."""
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest))
    return train([r.text for r in hash_sample(some, ["id", "text"], rows)])


def find_private(docs: DataFrame, model: lstm.Params, text: str = "text", found: str = "private") -> DataFrame:
    """All columns of docs and a struct ``found``: base and spans, arrays of (start, end, kind), and redacted, the text without them.

    Places are code points, ends exclusive. A null text has no spans and stays null; an empty one has
    none. Every row is read whole and by itself, so repeated rows get the same spans. ``found`` must
    not be a column of docs (ValueError). No shuffle.
    """
    absent(docs, found)
    columns = list(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = all_spans(shared.value, [t or "" for t in texts])
                rows = [[[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in pair] for pair in found]
                clean = [None if t is None else redacted(t, pair[1]) for t, pair in zip(texts, found)]
                value = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], span), pa.array([r[1] for r in rows], span), pa.array(clean, pa.string())], ["base", "spans", "redacted"])
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["row", "found"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    out = source.mapInArrow(run, f"row {kind}, found struct<base:{spans},spans:{spans},redacted:string>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_private(docs, fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("private.base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("private.base"), 256).alias("base_sha256"), listed("private.spans").alias("spans"))
