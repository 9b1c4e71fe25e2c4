"""Encoding and decoding with a SentencePiece model of merges.

A table holds, for each prefix of a text, the one last token that the merges leave there: of the
tokens that end at the place (found by an automaton over all tokens) it is the one that starts the
text or stands after a prefix whose own last token is compatible with it, that is, where merging the
characters of both tokens gives just these two. The ids are read off backwards from the end. Work is
linear in the text, without a queue of merges.

Texts are taken apart first where no token reaches across (before white space, and around characters
that no longer token holds), which the vocabulary proves; a task remembers the ids of such parts.
Each row by itself: no shuffle. The tables are those of the model, and are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm.common import absent, slices

#: Fixed value: what stands for a space in tokens.
SPACE = "▁"

#: Parts whose ids a task remembers, their longest length, and tested pairs that a task remembers.
REMEMBERED, REMEMBERED_LENGTH, PAIRS = 500_000, 48, 3_000_000


def default_model() -> str:
    """Path of the merge model of 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Symbols after all merges: always the pair of the lowest rank, the leftmost of equal ones."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Model:
    """The tables of a model, read once on the driver: pieces, ranks, ids of bytes, text of each id."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, self.end = range(library.get_piece_size()), library.eos_id()
        plain = [i for i in ids if not (library.is_unknown(i) or library.is_control(i) or library.is_byte(i))]
        self.ids = {library.id_to_piece(i): i for i in plain}
        order = {s: r for r, s in enumerate(sorted({library.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[library.get_score(i)] for p, i in self.ids.items()}
        self.bytes = {int(library.id_to_piece(i)[3:5], 16): i for i in ids if library.is_byte(i)}
        self.unknown = library.unk_id()
        # tokens that the merges do reach
        self.tokens = [p for p in self.ids if len(p) == 1 or merged(list(p), self.rank) == [p]]
        self.surface = [b""] * len(ids)
        for p, i in self.ids.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        if any(library.is_unused(i) for i in ids) or len(self.bytes) != 256:
            raise ValueError("models with unused pieces or without pieces for bytes are not supported")
        trial = f" A  bc\n{SPACE}d é́\U0001f9ffＡ" + "".join(self.tokens[:: max(1, len(self.tokens) // 200)])
        if Encoder(self).ids(trial) != library.encode(trial):
            raise ValueError("not a model of merges over text as it is (identity rule, a space before the text, white space kept)")


def part_pattern(longer: list[str]) -> str:
    """A pattern of parts that no token of several characters reaches across; longer are those tokens."""
    inner = sorted(set("".join(longer)) - {SPACE})
    of = lambda chars: "[" + "".join(map(re.escape, chars)) + "]" if chars else "(?!)"
    if any(SPACE in p.lstrip(SPACE) for p in longer):
        return f"{of([*inner, SPACE])}+|(?s:.)"
    kinds = [of(inner)]
    if not any(a != SPACE and b != SPACE and a.isalpha() != b.isalpha() for p in longer for a, b in zip(p, p[1:])):
        kinds = [of([c for c in inner if c.isalpha()]), of([c for c in inner if not c.isalpha()])]
    return f"{SPACE}*(?:{'|'.join(k + '+' for k in kinds)})|{SPACE}+|(?s:.)"


class Encoder:
    """Text to ids and back, with what a task remembers."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton, self.tested = ahocorasick.Automaton(), 0
        for t in model.tokens:
            self.automaton.add_word(t, (len(t), t, {}))  # with what was found of pairs that end in t
        self.automaton.make_automaton()
        self.parts = re.compile(part_pattern([p for p in model.ids if len(p) > 1])).findall
        self.known = _Known(self)

    def compatible(self, a: str, b: str, known: dict[str, bool]) -> bool:
        """Whether merging the characters of a and b gives a and b."""
        rank = self.model.rank
        ok = a + b not in rank and merged([*a, *b], rank) == [a, b]
        if self.tested < PAIRS:
            self.tested += 1
            known[a] = ok
        return ok

    def prefix_table(self, part: str) -> list[str]:
        """The last token of each prefix; empty where it is the last character itself, which is no token."""
        last, done = [""] * (len(part) + 1), -1
        for at, (size, t, known) in self.automaton.iter(part):
            if at == done:
                continue
            start = at + 1 - size
            if start:
                before = last[start] or part[start - 1]
                ok = known.get(before)
                if ok is None:
                    ok = self.compatible(before, t, known)
                if not ok:
                    continue
            last[at + 1], done = t, at
        return last

    def part_ids(self, part: str) -> tuple[int, ...]:
        last, out, at = self.prefix_table(part), [], len(part)
        while at:
            t = last[at] or part[at - 1]
            i = self.model.ids.get(t)
            out.extend((i,) if i is not None else (self.model.bytes[b] for b in reversed(t.encode())))
            at -= len(t)
        return tuple(reversed(out))

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        parts = self.parts(SPACE + text.replace(" ", SPACE))
        return list(chain.from_iterable(map(self.known.__getitem__, parts)))

    def text(self, ids: list[int]) -> str:
        """The text of ids: control ids are nothing, the space before the text goes, bytes that are no UTF-8 become U+FFFD each."""
        surface = self.model.surface
        raw = b"".join(map(surface.__getitem__, ids))
        first = next((i for i in ids if surface[i]), None)
        if first is not None and surface[first][:1] == b" " and first != self.model.unknown and first != self.model.bytes[32]:
            raw = raw[1:]
        try:
            if b"" not in map(surface.__getitem__, ids[:-1]):
                return raw.decode()
        except UnicodeDecodeError:
            pass
        runs = [b""]  # a control id parts bytes
        for i in ids:
            if surface[i]:
                runs[-1] += surface[i]
            else:
                runs.append(b"")
        whole = b"".join(runs)
        return "".join(_each_byte(r) for r in runs) if whole == raw else "".join(_each_byte(r) for r in runs)[1:]


class _Known(dict):
    """Ids of parts; short ones are remembered."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, part: str) -> tuple[int, ...]:
        found = self.encoder.part_ids(part)
        if len(part) <= REMEMBERED_LENGTH and len(self) < REMEMBERED:
            self[part] = found
        return found


def _each_byte(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


#: The encoder of this Python worker: what it remembers serves all tasks that the worker runs.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, tables: Model) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(tables)
    return _ENCODERS[path]


def encoded(docs: DataFrame, text: str = "text", found: str = "pieces", model_file: str | None = None, end: bool = True) -> DataFrame:
    """All columns of docs and a struct ``found``: ids (array of int), text (what the ids decode to).

    Ids are those of the library for the whole text, without sampling and without a start id; with end,
    the end id follows. A null text is empty: its ids are the end id alone. Each row is encoded by
    itself, repeated rows alike; an empty table gives no rows. ``found`` must not be a column of docs
    (ValueError), nor may the model be of another kind than ``Model`` supports.
    """
    absent(docs, found)
    path = model_file or default_model()
    shared = docs.sparkSession.sparkContext.broadcast(model(path))
    columns, place = list(docs.columns), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        last = [encoder.model.end] if end else []
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(place)], ["row", "text"])
            for part in slices(batch, 1):
                flat, sizes, texts = [], [0], []
                for t in part.column(1).to_pylist():
                    ids = encoder.ids(t or "") + last
                    flat.extend(ids)
                    sizes.append(len(flat))
                    texts.append(encoder.text(ids))
                ids = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.array(flat, np.int32)))
                value = pa.StructArray.from_arrays([ids, pa.array(texts, pa.string())], ["ids", "text"])
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["row", "found"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    out = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found struct<ids:array<int>,text:string>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found").alias(found))


def decoded(spark: SparkSession, ids: Column, model_file: str | None = None) -> Column:
    """The text of an array of ids, null for null; ids that the model doesn't have raise IndexError."""
    path = model_file or default_model()
    shared = spark.sparkContext.broadcast(model(path))

    @F.pandas_udf("string")
    def text(arrays):
        encoder = _encoder(path, shared.value)
        return arrays.map(lambda a: None if a is None else encoder.text(a.tolist()))

    return text(ids)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id and decoded again: number of ids, digests of ids and text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encoded(docs).select("doc_id", "pieces.*")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
