"""Passages that repeat across documents, by compact windows of min-hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import BATCH_ROWS, binary_text, map_batches, text_key
from cytogrid.llm.shingles import STEP, WORDS, WordHashes, mix, shingle, word_sums
from cytogrid.session import cut_lineage

#: Words of the shortest passage, and the shingles in it.
PASSAGE = 50
SPAN = PASSAGE - WORDS + 1
SIMILARITY = 0.8
#: Shingles that two passages of the shortest length share at the threshold.
ENOUGH = int(np.ceil(2 * SPAN * SIMILARITY / (1 + SIMILARITY)))
#: Shift of words inside a passage that an alignment may take up.
DRIFT = SPAN - ENOUGH + 4
#: Min-hash functions, and the equal minima on overlapping windows from which two texts are compared.
FUNCTIONS, AGREEING = 5, 2
#: Windows that a task combines before the shuffle, and rows of a batch behind it.
CHUNK, PORTION = 1_000_000, 50_000
MASK = (1 << 30) - 1
#: Level at which texts are packed.
PACKING = 6
#: Pairs of places of equal shingles that are looked at in one go.
PAIRS = 1 << 20
NONE = np.zeros(0, np.int64)
SEEDS = mix(np.arange(501, 501 + FUNCTIONS, dtype=np.uint64) * STEP)[:, None]


def window_minima(values: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The minimum of every ``span`` values in a row, along the last axis."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[..., :-size], values[..., size:])
        size *= 2
    rest = span - size
    return np.minimum(values[..., : values.shape[-1] - rest], values[..., rest:]) if rest else values


def compact_windows(shingles: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function, key, first start, last start) of the compact windows of a text.

    In the Cartesian tree over the values of one function, a node's subtree is the longest
    run in which its value is the minimum. The nodes whose subtrees hold at least ``span``
    values are just the minima of the windows of that length, so they are read off as runs of
    equal window minima: all subsequences that start in the run share this signature. There are about
    2 n / (span + 1) of them.
    """
    if len(shingles) < span:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    minima = window_minima(mix(shingles[None, :] ^ SEEDS), span)
    new = np.ones(minima.shape, bool)
    new[:, 1:] = minima[:, 1:] != minima[:, :-1]
    function, start = np.nonzero(new)
    end = np.r_[start[1:], 0] - 1
    end[np.r_[function[1:] != function[:-1], True]] = minima.shape[1] - 1
    return function, mix(minima[function, start] + SEEDS[function, 0]), start, end


def stars(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    """(key, owner, head): one row without a head for each key, its smallest owner, and one row for each
    other owner and the smallest one of a key that it has. The key of the latter only spreads them."""
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.r_[True, key[1:] != key[:-1]][: len(key)]
    head = owner[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    spokes = np.unique(np.stack([head, owner], 1)[head != owner], axis=0)
    heads = np.r_[np.zeros(int(first.sum()), np.int64), spokes[:, 0]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[key[first], spokes[:, 1]]),
            pa.array(np.r_[owner[first], spokes[:, 1]]),
            pa.array(heads, mask=np.arange(len(heads)) < first.sum()),
        ],
        ["key", "owner", "head"],
    )


def linked(starred: DataFrame) -> DataFrame:
    """(a, b) with a < b: the owners of each key linked to the smallest one and to the one before."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_head = last_owner = None
        for batch in batches:
            key, owner = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            drawn = batch.column(2)
            local = drawn.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([drawn.filter(pa.array(local)), pa.array(owner[local])], ["a", "b"])
            key, owner = key[~local], owner[~local]
            if not len(key):
                continue
            first = np.r_[key[0] != last_key, key[1:] != key[:-1]]
            head_at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            head = np.where(head_at >= 0, owner[head_at], 0 if last_head is None else last_head)
            before = np.r_[owner[0] if last_owner is None else last_owner, owner[:-1]]
            star = ~first & (head != owner)
            chain = star & (before != owner) & (before != head)
            pairs = np.unique(np.stack([np.r_[head[star], before[chain]], np.r_[owner[star], owner[chain]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])
            last_key, last_head, last_owner = key[-1], head[-1], owner[-1]

    parts = int(starred.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = starred.repartition(parts, "key").sortWithinPartitions("key", "owner")
    return map_batches(placed, connect, "a long, b long", rows=PORTION).distinct()


def live_windows(docs: DataFrame) -> DataFrame:
    """(owner, key, place): the compact windows whose signature another text has, too.

    ``place`` holds function, first start and length of the interval of starts. Tasks know the signatures
    that several of their own texts have, and pass on the windows of the smallest such text only.
    """
    hashes = WordHashes()

    def combine(keys: list[np.ndarray], owners: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
        key, owner, place = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((owner, key))
        key, owner, place = key[order], owner[order], place[order]
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(first) - 1
        head = owner[first][group]
        several = np.bincount(group, head != owner) > 0
        names = ["route", "key", "owner", "place", "live"]
        route = np.where(head == owner, key, owner)  # the others only need a place
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (route, key, owner, place, several[group].astype(np.int8) + (head != owner))], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, places, held, seen = [], [], [], 0, set()
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if owner in seen:  # a copy
                    continue
                seen.add(owner)
                function, key, start, end = compact_windows(shingle(hashes.of(text.split())))
                keys.append(key.view(np.int64))
                owners.append(np.full(len(key), owner, np.int64))
                places.append((function << 60) | (start << 30) | (end - start))
                held += len(key)
            if held >= CHUNK:
                yield combine(keys, owners, places)
                keys, owners, places, held, seen = [], [], [], 0, set()
        if held:
            yield combine(keys, owners, places)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 1):
            key, owner, live = (table.column(i).to_numpy() for i in (1, 2, 4))
            sent = live < 2
            kept = ~sent
            if sent.any():
                first = np.r_[True, key[sent][1:] != key[sent][:-1]]
                group = np.cumsum(first) - 1
                own = (owner[sent] != owner[sent][first][group]) | (live[sent] > 0)
                kept[sent] = (np.bincount(group, own) > 0)[group]
            yield table.select(["owner", "key", "place"]).filter(pa.array(kept))

    rows = docs.select(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("owner"), binary_text().alias("text"))
    windows = map_batches(rows, emit, "route long, key long, owner long, place long, live byte")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = windows.repartition(parts, "route").sortWithinPartitions("key", "owner")
    return map_batches(placed, shared, "owner long, key long, place long", rows=PORTION)


def whole_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in other portions, none of which ends inside a run of equal values of the column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        if not len(values):
            continue
        change = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and values[0] != held[-1].column(column)[-1].as_py():
            yield pa.concat_batches(held)
            held = []
        if len(change):
            yield pa.concat_batches([*held, batch.slice(0, change[-1])])
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def joined_intervals(owner: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, their owners) of intervals of two functions that overlap, (owners, first, last) of the starts all functions have.

    Owners stand in a row. A key names the signatures of both functions: texts with an equal one
    agree in ``AGREEING`` functions on windows that overlap.
    """
    number = np.cumsum(np.r_[True, owner[1:] != owner[:-1]][: len(owner)]) - 1
    names = owner[np.r_[True, owner[1:] != owner[:-1]][: len(owner)]]
    function = place >> 60
    start = (number << 31) + ((place >> 30) & MASK)
    end = start + (place & MASK)
    order = np.lexsort((start, function))
    bounds = np.searchsorted(function[order], np.arange(FUNCTIONS + 1))
    keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sorted_by = [order[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
    for f, left in enumerate(sorted_by):
        for right in sorted_by[f + 1 :]:
            low = np.searchsorted(end[right], start[left])
            n = np.searchsorted(start[right], end[left], "right") - low
            i = np.repeat(left, n)
            j = right[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            keys.append(mix(mix(key[i].view(np.uint64)) + key[j].view(np.uint64)).view(np.int64))
            owners.append(owner[i])
    at, place_of = np.unique(np.r_[start, end + 1], return_inverse=True)
    depth = np.cumsum(np.bincount(place_of, np.repeat([1, -1], len(start)), len(at))).astype(np.int64)
    full = np.flatnonzero(depth == FUNCTIONS)
    first, last = at[full], at[np.minimum(full + 1, len(at) - 1)] - 1
    return np.concatenate(keys), np.concatenate(owners), names[first >> 31], first & (2**31 - 1), last & (2**31 - 1)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) hashes of texts with a < b, and (owner, first, last) starts of passages that may be repeated word by word.

    Windows are joined by the signatures of two functions on intervals that overlap, so each text's agreement
    counts within its group, whichever text comes first under either signature. Texts with an equal pair of signatures form a star
    around the text with the smallest hash, and a chain; a star has as many links as members, however many
    texts share a line. Where windows start that other texts share under all functions, ``exact_links`` looks for exact repeats.
    """
    live = live_windows(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = live.repartition(parts, "owner").sortWithinPartitions("owner", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        names = ["key", "owner", "head", "last"]

        def out() -> pa.RecordBatch:
            found = stars(keys, owners)
            return pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.int64())], names)

        for table in whole_runs(batches, 0):
            owner, key, place = (table.column(i).to_numpy() for i in range(3))
            fresh = np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])]  # copies in other tasks
            found, of, who, first, last = joined_intervals(owner[fresh], key[fresh], place[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first, who, first, last)], names)
            keys.append(found)
            owners.append(of)
            held += len(found)
            if held >= CHUNK:
                yield out()
                keys, owners, held = [], [], 0
        if held:
            yield out()

    found = cut_lineage(map_batches(placed, work, "key long, owner long, head long, last long", rows=PORTION))
    ranges = found.where("last IS NOT NULL").select("owner", F.col("key").alias("first"), "last")
    return linked(found.where("last IS NULL").select("key", "owner", "head")), ranges


def exact_links(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) with a < b: packed texts (owner, text) that repeat 50 words, linked to the smallest text that has them.

    An exact repeat has the same signature under every function, so its start is in ``ranges``: none is lost.
    """
    listed = ranges.groupBy("owner").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            for owner, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = shingle(word_sums(unpack(text)))
                starts = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in spans])
                value = np.zeros(len(starts), np.uint64)
                for i in range(0, PASSAGE, WORDS):
                    value = mix(value * STEP + shingles[starts + i])
                keys.append(np.unique(value).view(np.int64))
                owners.append(np.full(len(keys[-1]), owner, np.int64))
                held += len(keys[-1])
            if held >= CHUNK:
                yield stars(keys, owners)
                keys, owners, held = [], [], 0
        if held:
            yield stars(keys, owners)

    rows = texts.join(listed, "owner").select("owner", "text", "ranges")
    return linked(map_batches(rows, work, "key long, owner long, head long"))


def covered(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first word, words) of the runs of windows that hold enough matching shingles."""
    if len(mask) < SPAN:
        return []
    sums = np.r_[0, np.cumsum(mask)]
    good = np.flatnonzero(sums[SPAN:] - sums[:-SPAN] >= ENOUGH)
    if not len(good):
        return []
    cuts = np.flatnonzero(np.diff(good) > SPAN) + 1
    spans = []
    for run in np.split(good, cuts):
        hits = np.flatnonzero(mask[run[0] : run[-1] + SPAN]) + run[0]
        first, words = int(hits[0]), int(hits[-1] - hits[0] + WORDS)
        if words < PASSAGE:  # a change at the very edge
            first, words = int(run[0]), int(run[-1] - run[0] + PASSAGE)
        spans.append((first, words))
    return spans


@dataclass
class Prepared:
    """Shingles of a text, its different ones in order, and where the places of each begin in ``places``."""

    shingles: np.ndarray
    distinct: np.ndarray
    begin: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Prepared:
        shingles = shingle(words)
        places = np.argsort(shingles, kind="stable")
        ordered = shingles[places]
        begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        return cls(shingles, ordered[begin], np.append(begin, len(ordered)), places)


def diagonals(a: Prepared, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Matching shingles on every diagonal, that of (last of a, first of b) first: all places in a meet all in b, at
    whose places ``hit`` the shingles are a's different ones of the numbers ``at``."""
    out = np.zeros(len(a.shingles) + len(at) - 1, np.int64)
    begin, count = a.begin[at[hit]], a.begin[at[hit] + 1] - a.begin[at[hit]]
    total = np.cumsum(count)
    cuts = np.unique(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)))
    for low, high in zip([0, *cuts], [*cuts, len(hit)], strict=True):
        n = count[low:high]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = a.places[np.repeat(begin[low:high], n) + within]
        out += np.bincount(np.repeat(hit[low:high], n) - places + len(a.shingles) - 1, minlength=len(out))
    return out


def shared_spans(a: Prepared, b: Prepared) -> list[tuple[int, int, int, int]]:
    """(start in a, words in a, start in b, words in b) of near-duplicate passages.

    Shingles are matched along the diagonals on which shingles of both texts meet, wherever they
    are repeated; diagonals closer than an alignment may drift count together. A passage is a run of
    windows in which so many shingles match that the Jaccard similarity is at least 0.8.
    """
    sa, sb = a.shingles, b.shingles
    if len(sa) < SPAN or len(sb) < SPAN:
        return []
    at = np.minimum(np.searchsorted(a.distinct, sb), len(a.distinct) - 1)
    known = a.distinct[at] == sb
    upto = np.cumsum(known)
    if upto[SPAN - 1] < ENOUGH and (upto[SPAN:] - upto[:-SPAN] < ENOUGH).all():
        return []  # no window of b has enough shingles that are anywhere in a
    counts = diagonals(a, at, np.flatnonzero(known))
    seeds = np.flatnonzero(counts >= WORDS)
    if not len(seeds):
        return []
    there = np.flatnonzero(counts)
    found = []
    for seed in np.split(seeds, np.flatnonzero(np.diff(seeds) > DRIFT) + 1):
        group = there[np.searchsorted(there, seed[0] - DRIFT) : np.searchsorted(there, seed[-1] + DRIFT, "right")]
        if counts[group].sum() < ENOUGH:
            continue
        mask_a, mask_b = np.zeros(len(sa), bool), np.zeros(len(sb), bool)
        for d in group - len(sa) + 1:
            low, high = max(0, d), min(len(sb), len(sa) + d)
            equal = sb[low:high] == sa[low - d : high - d]
            mask_b[low:high] |= equal
            mask_a[low - d : high - d] |= equal
        in_b = covered(mask_b)
        in_a = covered(mask_a) if in_b else []
        narrow = len(seed) == 1 or seed[-1] - seed[0] <= DRIFT
        shared = [] if narrow else [shared_upto(a, partner, at, known) for partner in in_a]
        for start, words in in_b:
            for i, partner in enumerate(in_a):
                if narrow:
                    shift = int(seed[len(seed) // 2]) - len(sa) + 1
                    meet = partner[0] + shift < start + words + DRIFT and start < sum(partner) + shift + DRIFT
                else:  # many diagonals: no one of them tells which passages belong together
                    end = min(start + words - WORDS + 1, len(sb))
                    meet = shared[i][end] - shared[i][start] >= ENOUGH
                if meet:
                    found.append((*partner, start, words))
    return found


def shared_upto(a: Prepared, passage: tuple[int, int], at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many of b's first shingles, for each number of them, are among those of a's passage."""
    inside = np.zeros(len(a.distinct), bool)
    inside[np.searchsorted(a.distinct, a.shingles[passage[0] : sum(passage) - WORDS + 1])] = True
    return np.r_[0, np.cumsum(inside[at] & known)]


def pack(text: bytes) -> bytes:
    """The text, each packed by itself, as it is shuffled with every pair; its size stands before it."""
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", PACKING).compress(text, asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(key, start, words, other_key, removed): passages of a text that another text has, too.

    Both sides of a pair of different texts are returned; ``removed`` marks the side of the text with the larger
    hash, so of all texts that share a passage the one with the smallest hash is left alone. ``key`` is
    the text's ``text_key``. Equal texts count as one text here.
    """
    texts = docs.select(
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("owner"), text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id")
    )
    near, ranges = candidates(docs)
    near = cut_lineage(near)
    owners = near.select(F.col("a").alias("owner")).union(near.select(F.col("b").alias("owner"))).union(ranges.select("owner")).distinct()
    wanted = cut_lineage(
        texts.join(owners, "owner").groupBy("owner", "key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("holder"))
    )
    place = ["key", "no_id", "id"]  # joined and grouped by the same columns, texts are shuffled once
    held = docs.select(text_key().alias("key"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    asked = wanted.select("owner", "key", F.col("holder.col1").alias("no_id"), F.col("holder.doc_id").alias("doc_id"))
    held, asked = (x.withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id") for x in (held, asked))
    fetched = held.join(asked, place).groupBy(*place).agg(F.first("owner").alias("owner"), F.first("text").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([pack(text) for text in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], ["owner", "key", "text"])

    fetched = cut_lineage(map_batches(fetched.select("owner", "key", "text"), packed, "owner long, key binary, text binary"))
    pairs = near.union(exact_links(ranges, fetched.select("owner", "text"))).distinct()
    both = (
        pairs.join(fetched.withColumnsRenamed({"owner": "b", "key": "key_b", "text": "text_b"}), "b")
        .join(fetched.withColumnsRenamed({"owner": "a", "key": "key_a", "text": "text_a"}), "a")  # pairs of one a stay together
        .select("key_a", "key_b", "text_a", "text_b")
    )
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            out = []
            for key_a, key_b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key_a != last:
                    last, a = key_a, Prepared.of(word_sums(unpack(text_a)))
                b = Prepared(shingle(word_sums(unpack(text_b))), NONE, NONE, NONE)
                for start_a, words_a, start_b, words_b in shared_spans(a, b):
                    out += [(key_a, start_a, words_a, key_b, False), (key_b, start_b, words_b, key_a, True)]
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "words", "other_key", "removed"])

    found = map_batches(both, compare, "key binary, start long, words long, other_key binary, removed boolean")
    return found.distinct()


def keepers(docs: DataFrame) -> DataFrame:
    """(key, keeper, copies): of equal texts, the smallest id (null last)."""
    rows = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    return rows.groupBy("key").agg(F.min(order)["doc_id"].alias("keeper"), F.count("*").alias("copies"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, other_doc_id, removed) of repeated passages of at least 50 words.

    One row per passage of a distinct text and partner text, under the smallest doc_id of either (null last); a text
    that occurs several times gives one row more for each further copy: the whole text, removed (rows that
    repeat both id and text are one document). Null, empty and short texts have no passages. A repeat inside one text alone is not reported.
    Very long texts are searched whole. Other columns are ignored.
    """
    names = cut_lineage(keepers(docs))
    spans = cut_lineage(repeated_passages(docs))
    named = (
        spans.join(names.select("key", F.col("keeper").alias("doc_id")), "key")
        .join(names.select(F.col("key").alias("other_key"), F.col("keeper").alias("other_doc_id")), "other_key")
        .select("doc_id", F.col("start").alias("start_word"), F.col("words").alias("n_words"), "other_doc_id", "removed")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([len(text.split()) for text in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], words], ["key", "doc_id", "n_words"])

    rows = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    rows = map_batches(rows, count, "key binary, doc_id long, n_words long")
    again = names.where("copies > 1").select("key", "keeper")
    copies = rows.join(again, "key").where((F.col("n_words") >= PASSAGE) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return named.unionByName(
        copies.select(
            "doc_id",
            F.lit(0).cast("long").alias("start_word"),
            "n_words",
            F.col("keeper").alias("other_doc_id"),
            F.lit(True).alias("removed"),
        )
    )


WORD_LIST = r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w != '')"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, and without the blanks behind each of them.

    >>> cut_spans(b"a b  c d", [(1, 2)])
    b'a d'
    """
    bounds = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, words in sorted(spans):
        end = min(start + words, len(bounds))
        if start >= end:
            continue
        low, high = bounds[start][0], bounds[end][0] if end < len(bounds) else len(text)
        if low > at:
            kept.append(text[at:low])
        at = max(at, high)
    return b"".join([*kept, text[at:]])


def cut_passages(docs: DataFrame) -> DataFrame:
    """The documents without the passages marked as removed; ``n_chars``, if there, follows the text.

    Columns and their order stay. Of equal texts of at least 50 words that with the smallest doc_id
    (null last) stays whole; the others lose all their text (rows that repeat both id and text are one
    document). Rows that lose their last word so are dropped; rows that had no word before stay as they
    are, null texts too.
    """
    names = cut_lineage(keepers(docs))
    cuts = repeated_passages(docs).where("removed").groupBy("key").agg(F.collect_set(F.struct("start", "words")).alias("cuts"))
    marks = cuts.join(names.where("copies > 1"), "key", "full")
    whole = docs.select(F.struct("*").alias("row"), text_key().alias("key")).join(marks, "key", "left")
    copy = F.col("copies").isNotNull() & ~F.col("row.doc_id").cast("long").eqNullSafe(F.col("keeper"))

    @F.pandas_udf("string")
    def shorten(texts, cuts, copies):
        import pandas as pd

        out = []
        for text, spans, copied in zip(texts, cuts, copies, strict=True):
            words = text.split()
            if copied and len(words) >= PASSAGE:
                spans = [{"start": 0, "words": len(words)}]
            pairs = [(int(x["start"]), int(x["words"])) for x in spans] if spans is not None else []
            short = cut_spans(text, pairs)
            out.append(short.decode() if short.split() or not words else None)
        return pd.Series(out, dtype=object)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    touched = F.col("cuts").isNotNull() | copy
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    edited = whole.where(touched).select("row", shorten(text, "cuts", copy).alias("short")).where("short IS NOT NULL")
    changed = {"text": F.col("short"), "n_chars": F.length("short").cast(dict(docs.dtypes).get("n_chars", "long"))}
    columns = [changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns]
    return whole.where(~touched).select("row.*").union(edited.select(*columns))
