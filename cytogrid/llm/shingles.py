"""Hashes of words and of runs of five words."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5  # of a shingle
STEP, MIX_1, MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words; starts afresh at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 800_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Of a byte: whether it is a blank, and a number that stands for it.
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes whose words are hashed in one go, and the longest word that is hashed by a sum of powers.
SPAN_BYTES, LONG_WORD = 1 << 18, 256
BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def powers(size: int) -> list[np.ndarray]:
    """The powers of ``BASE`` and of its inverse, modulo 2**64, at least ``size`` of each."""
    if not _powers or len(_powers[0]) < size:
        steps = (np.full(max(size, SPAN_BYTES), x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        _powers[:] = [np.r_[np.uint64(1), np.cumprod(x)] for x in steps]
    return _powers


def word_sums(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``text.split()``, other ones than those of ``WordHashes`` and only fit to find equal words."""
    codes = np.frombuffer(text, np.uint8)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = BLANK[codes]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    part = start // SPAN_BYTES
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)], strict=True):
        if low == high:
            continue
        first, last = start[low], end[high - 1]
        up, down = powers(last - first + 1)
        upto = np.zeros(last - first + 1, np.uint64)
        np.cumsum(BYTES[codes[first:last]] * up[: last - first], out=upto[1:])
        at = start[low:high] - first
        out[low:high] = (upto[end[low:high] - first] - upto[at]) * down[at]
    sizes = end - start
    for i in np.flatnonzero(sizes > LONG_WORD):  # sums of powers could be equal for some long words
        out[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]])
    return mix(out + sizes.view(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle(words: np.ndarray) -> np.ndarray:
    """One hash for each five words in a row; a shorter text is a single shingle, an empty one has none."""
    size = min(WORDS, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = out * STEP + words[i : len(words) - size + 1 + i]
    return mix(out + np.uint64(size))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(values) else np.zeros(0, bool)
    place = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out
