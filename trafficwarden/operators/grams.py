"""Character n-grams within words (2 to 4 characters, each word between two spaces) of whole batches of texts.

An n-gram is a number: the ids of its characters, 16 bits each. Batches are cut into pieces of a bounded
number of characters (a text stays whole), so memory doesn't grow with the batch. The n-grams are those
of ``word_ngrams``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Shortest and longest n-gram.
LOW, HIGH = 2, 4
#: Characters of the texts that are looked at together.
CHARACTERS = 1 << 18
#: Most characters with an id of their own.
MOST_IDS = (1 << 16) - 1
_POINTS = 0x110000

# Fixed value: white space, as the native n-grams see it.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[_SPACES] = True


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts of about ``CHARACTERS`` together."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHARACTERS, "right")))
        yield begin, stop
        begin = stop


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts with one space before, between and behind the words; the text of each; whether it is a space."""
    codes = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le"), np.uint32)
    row = np.concatenate([[0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])])
    space = _IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)]
    keep = np.append(True, ~(space[1:] & space[:-1]))
    codes, row, space = codes[keep], row[keep], space[keep]
    codes[space] = 32
    return codes, row, space


def _places(ids: np.ndarray, row: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text) of every place; ids of characters are 0 where no n-gram may hold them."""
    ids, grams, rows = ids.astype(np.uint64), [], []
    known, inner = ids > 0, ~space[1:-1]  # a space stands only at either end
    wide = ids
    for n in range(LOW, HIGH + 1):
        wide = (wide[:-1] << np.uint64(16)) | ids[n - 1 :]
        known = known[:-1] & (ids[n - 1 :] > 0)
        some = known
        for j in range(1, n - 1):
            some = some & inner[j - 1 : len(inner) - (n - 2 - j)]
        some = np.flatnonzero(some)
        grams.append(wide[some])
        rows.append(row[some + 1] if n > 2 else np.where(space[some], row[some + 1], row[some]))
    return np.concatenate(grams), np.concatenate(rows)


def counted(texts: list[str], weights: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(n-grams, texts that hold them, places of them) of pieces of the texts, each text as often as its weight says."""
    for begin, stop in pieces(texts):
        yield from _counted(texts[begin:stop], weights[begin:stop])


def _counted(texts: list[str], weights: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    codes, row, space = _words(texts)
    if len(codes) < 3:
        return
    table = np.zeros(_POINTS, np.int32)
    table[codes] = 1
    points = np.flatnonzero(table)
    if len(points) > MOST_IDS:
        if len(texts) == 1:
            yield _one_by_one(texts[0], int(weights[0]))
            return
        half = len(texts) // 2
        yield from _counted(texts[:half], weights[:half])
        yield from _counted(texts[half:], weights[half:])
        return
    table[points] = np.arange(1, len(points) + 1)
    grams, rows = _places(table[codes], row, space)
    found, at = _different(grams)
    places = np.bincount(at, weights[rows], len(found)).astype(np.int64)
    pairs = np.sort(at * len(texts) + rows)  # several times as fast as unique
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    held = np.bincount(pairs // len(texts), weights[pairs % len(texts)], len(found)).astype(np.int64)
    ids = (found[:, None] >> np.array([48, 32, 16, 0], np.uint64)) & np.uint64(0xFFFF)
    lengths = (ids > 0).sum(1).tolist()
    whole = np.append(0, points).astype(np.uint32)[ids.astype(np.int64)].tobytes().decode("utf-32-le")
    yield [whole[4 * i + 4 - n : 4 * i + 4] for i, n in enumerate(lengths)], held, places


def _hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _different(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (none is 0) in any order, and the place of each code among them. One code of those that meet in a slot has it; only the others are sorted."""
    bits = max(int(2 * len(codes)).bit_length(), 4)
    slot, slots = _hashed(codes, bits), np.zeros(1 << bits, np.uint64)
    slots[slot] = codes
    own, used = slots[slot] == codes, np.flatnonzero(slots)
    place = np.zeros(1 << bits, np.int64)
    place[used] = np.arange(len(used))
    at = place[slot]
    others, behind = np.unique(codes[~own], return_inverse=True)
    at[~own] = behind + len(used)
    return np.concatenate([slots[used], others]), at


def _one_by_one(text: str, weight: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same for a text of more different characters than there are ids."""
    from collections import Counter

    codes, _, space = _words([text])
    words = codes.tobytes().decode("utf-32-le").split(" ")
    grams = Counter(f" {w} "[i : i + n] for w in words if w for n in range(LOW, min(HIGH, len(w) + 2) + 1) for i in range(len(w) + 3 - n))
    return list(grams), np.full(len(grams), weight, np.int64), np.array(list(grams.values()), np.int64) * weight


class GramWeights:
    """The n-grams of a vocabulary with their weights; rows of texts become rows of length one of weighted counts.

    ``usable`` is whether the vocabulary has few enough characters.
    """

    def __init__(self, vocabulary: list[str], weights: np.ndarray):
        self.size, self.weights = len(vocabulary), np.asarray(weights, float)
        index = [i for i, g in enumerate(vocabulary) if LOW <= len(g) <= HIGH]  # no other is ever found
        self.points = np.array(sorted({ord(c) for i in index for c in vocabulary[i]}), np.int64)
        self.usable = len(self.points) <= MOST_IDS
        self._ids = None
        if not self.usable:
            return
        id_ = {int(c): i + 1 for i, c in enumerate(self.points)}
        codes = np.zeros(len(index), np.uint64)
        for at, i in enumerate(index):
            code = 0
            for c in vocabulary[i]:
                code = code << 16 | id_[ord(c)]
            codes[at] = code
        # slots by a product's leading bits, the next free one for those that meet
        self.bits = max(int(4 * len(codes)).bit_length(), 4)
        self.slots, self.index = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        left, place = np.arange(len(codes)), _hashed(codes, self.bits)
        while len(left):
            slot = place[left]
            first = np.unique(slot, return_index=True)[1]
            first = first[self.slots[slot[first]] == 0]
            self.slots[slot[first]], self.index[slot[first]] = codes[left[first]], np.array(index, np.int32)[left[first]]
            left = np.delete(left, first)
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ids": None}  # 2 MB that a worker makes for itself

    def _found(self, grams: np.ndarray) -> np.ndarray:
        """The place of each n-gram in the vocabulary, -1 for others."""
        out, left, slot = np.full(len(grams), -1, np.int32), np.arange(len(grams)), _hashed(grams, self.bits)
        while len(left):
            there = self.slots[slot]
            hit = there == grams[left]
            out[left[hit]] = self.index[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, ends, n-gram, value) of pieces of the texts: the entries of text i end at ends[i], in order of the vocabulary."""
        texts = [t or "" for t in texts]
        if self._ids is None:
            self._ids = np.zeros(_POINTS, np.uint16)
            self._ids[self.points] = np.arange(1, len(self.points) + 1)
        for begin, stop in pieces(texts):
            n = stop - begin
            codes, row, space = _words(texts[begin:stop])
            if len(codes) < 3:
                yield n, np.zeros(n, np.int64), np.empty(0, np.int32), np.empty(0)
                continue
            grams, rows = _places(self._ids[codes], row, space)
            at = self._found(grams)
            some = at >= 0
            pairs = np.sort(rows[some] * self.size + at[some])
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(pairs)))
            rows, at = np.divmod(pairs[first], self.size)
            value = counts * self.weights[at]
            length = np.sqrt(np.bincount(rows, value * value, n))
            yield n, np.cumsum(np.bincount(rows, minlength=n)), at.astype(np.int32), value / length[rows]


def linear(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]], coefficients: np.ndarray, intercepts: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of value times coefficient (n-gram x class) and the intercepts for the rows of ``GramWeights``."""
    for n, ends, at, value in rows:
        out = np.zeros((n, len(intercepts)))
        begins = np.append(0, ends[:-1])
        some = np.flatnonzero(ends > begins)
        if len(some):
            out[some] = np.add.reduceat(coefficients[at] * value[:, None], begins[some], axis=0)
        yield out + intercepts
