"""Posting lists of one segment of documents in compressed blocks, and their search by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Postings of a block, and documents of a segment that are scored side by side.
BLOCK, SPAN = 64, 2048
#: Fixed values of the score.
UNIT, FLAT, SLOPE, TF, LENGTH = 1_000_000_000, 50, 50, 1000, 20


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; the first byte is that width."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, f"<u{width}", count, at + 1).astype(np.int64), at + 1 + width * count


def skyline(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The postings no other of the block beats in both: a rising tf at a rising length. Scores rise with the one
    and fall with the other, so the block's highest is among them whatever the collection's statistics turn out."""
    order = np.lexsort((-tf, length))
    best = np.maximum.accumulate(tf[order])
    return order[np.r_[True, best[1:] > best[:-1]]]


def encode(docs: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> dict[str, bytes]:
    """A list in ascending order of ``docs`` as block heads (first, last, offset), payloads and skylines."""
    heads, payload, tops, at = [], [], [], 0
    for start in range(0, len(docs), BLOCK):
        d, t = docs[start : start + BLOCK], tf[start : start + BLOCK]
        body = pack(np.diff(d)) + pack(t)
        heads.append((d[0], d[-1], at, len(d)))
        payload.append(body)
        at += len(body)
        n = lengths[d]
        keep = skyline(t, n)
        tops += [(start // BLOCK, t[i], n[i]) for i in keep]
    as_bytes = lambda rows: np.array(rows, "<i8").tobytes()
    return {"heads": as_bytes(heads), "payload": b"".join(payload), "tops": as_bytes(tops)}


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The share of the score that the weight is multiplied by, in whole numbers rounded down."""
    m = 100 - FLAT + (SLOPE * length * n_docs) // n_terms
    return (UNIT * tf) // (TF * tf + LENGTH * m)


class PostingList:
    """A term's list in one segment: block bounds are at hand, blocks are decompressed when asked for."""

    def __init__(self, heads: bytes, payload: bytes, tops: bytes, weight: int, n_docs: int, n_terms: int):
        table = np.frombuffer(heads, "<i8").reshape(-1, 4)
        self.first, self.last, self.offset, self.count = table.T
        self.payload, self.weight = payload, weight
        block, tf, length = np.frombuffer(tops, "<i8").reshape(-1, 3).T
        self.highest = np.zeros(len(table), np.int64)
        np.maximum.at(self.highest, block, weight * impact(tf, length, n_docs, n_terms))
        self.bound = int(self.highest.max())
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, block: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block; ``base`` holds each document's own part of the divisor."""
        found = self.opened.get(block)
        if found is None:
            count = int(self.count[block])
            gaps, at = unpack(self.payload, int(self.offset[block]), count - 1)
            tf, _ = unpack(self.payload, at, count)
            docs = self.first[block] + np.r_[0, np.cumsum(gaps)]
            found = self.opened[block] = docs, self.weight * ((UNIT * tf) // (TF * tf + base[docs]))
        return found

    def between(self, low: int, high: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents from ``low`` on and before ``high``."""
        blocks = range(int(np.searchsorted(self.last, low)), int(np.searchsorted(self.first, high)))
        if not blocks:
            return self.first[:0], self.first[:0]
        parts = [self.open(b, base) for b in blocks]
        docs, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        inside = slice(*np.searchsorted(docs, (low, high)))
        return docs[inside], scores[inside]

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that may hold each document, -1 where none does."""
        block = np.searchsorted(self.last, docs)
        fits = block < len(self.first)
        fits[fits] = self.first[block[fits]] <= docs[fits]
        return np.where(fits, block, -1)


class Best:
    """The ``k`` best (score, id) so far, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this one cannot enter; an equal one can, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(lists: Sequence[PostingList], base: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Brings the segment's documents into ``best``.

    Lists are ordered by their bounds. The lowest of them, whose bounds together stay below the least score that can
    still enter, cannot bring a document in alone: they are not essential, and only documents of the other, essential
    lists are candidates. These are scored span by span, and each span starts with the limits the one before it raised.
    A candidate meets the other lists from the highest bound down; it is dropped as soon as its score, the bound of
    the block it would be in and the bounds of the lists still to come stay below the limit, and blocks are opened
    for the candidates left only.
    """
    lists = sorted((x for x in lists if x.weight > 0), key=lambda x: x.bound)
    upto = np.cumsum([0, *[x.bound for x in lists]])  # what the first i lists can add
    for low in range(0, len(ids), SPAN):
        high = min(low + SPAN, len(ids))
        essential = int(np.searchsorted(upto[1:], best.least))  # the first sum that reaches the limit
        if essential == len(lists):
            return  # nothing here can enter, nor later, as limits only rise
        total = np.zeros(high - low, np.int64)
        for postings in lists[essential:]:
            docs, scores = postings.between(low, high, base)
            total[docs - low] += scores
        found = np.flatnonzero(total)
        scores = total[found]
        for i in range(essential - 1, -1, -1):
            alive = scores + upto[i + 1] >= best.least
            found, scores = found[alive], scores[alive]
            if not len(found):
                break
            block = lists[i].block_of(found + low)
            at_most = np.where(block >= 0, lists[i].highest[block], 0)
            alive = scores + at_most + upto[i] >= best.least
            found, scores, block = found[alive], scores[alive], block[alive]
            for b in np.unique(block[block >= 0]):
                docs, gained = lists[i].open(int(b), base)
                mine = np.flatnonzero(block == b)
                at = np.searchsorted(docs, found[mine] + low)
                hit = docs[at] == found[mine] + low  # within the block, so ``at`` is a place in it
                scores[mine[hit]] += gained[at[hit]]
        enough = scores >= best.least
        if enough.any():
            best.add(scores[enough], ids[found[enough] + low])
