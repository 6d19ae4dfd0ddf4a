"""Near-duplicate documents by order min-hash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.blocks import pairs_in_groups
from cytogrid.llm.common import BATCH_ROWS, binary_text, components, map_batches, text_key
from cytogrid.llm.shingles import STEP, WORDS, WordHashes, mix, occurrences, shingle
from cytogrid.session import cut_lineage

SIMILARITY = 0.8
#: Sketches of a text, and the shingles in each. A pair at the threshold shares a sketch with
#: probability 0.8**4 = 0.41, and none of the twenty with 2.6e-5.
SKETCHES, SHINGLES = 20, 4
#: Texts of a block of a bucket; a task holds two.
BLOCK_TEXTS = 256
MIXER = np.uint64(0xD6E8FEB86659FD93)
POWERS = mix(np.arange(101, 101 + SHINGLES, dtype=np.uint64) * STEP) | np.uint64(1)
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * STEP)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Shingles of a text, different for each occurrence of the same one."""
    shingles = shingle(words)
    return shingles + occurrences(shingles).astype(np.uint64) * STEP


def sketch(words: np.ndarray) -> np.ndarray:
    """Order min-hashes of a text's word hashes.

    Shingles are labelled by their occurrence. Each sketch takes the shingles with the smallest hashes
    under its own permutation, and keeps them in the order of the text.
    """
    labelled = labelled_shingles(words)
    few = min(SHINGLES, len(labelled))
    keys = np.empty(SKETCHES, np.uint64)
    for j, seed in enumerate(SEEDS):
        value = (labelled ^ seed) * MIXER
        value ^= value >> np.uint64(32)
        least = np.argpartition(value, few - 1)[:few] if few < len(value) else np.arange(few)
        ordered = (labelled[np.sort(least)] ^ seed) * POWERS[:few]
        keys[j] = mix(ordered.sum(keepdims=True) ^ seed)[0]
    return keys


def align(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int, int]] | None:
    """Runs (start in a, start in b, length) of an alignment with the fewest insertions and deletions.

    Diagonals are followed as far as they match; only the band that ``most`` insertions and
    deletions can reach is looked at. None if they do not suffice.
    """
    n, m = len(a), len(b)

    def run(x: int, y: int) -> int:
        start, step = x, 16
        while x < n and y < m:
            part = min(step, n - x, m - y)
            differ = a[x : x + part] != b[y : y + part]
            first = int(differ.argmax())
            if differ[first]:
                return x + first - start
            x, y, step = x + part, y + part, step * 4
        return x - start

    reach = np.full(2 * most + 3, -1, np.int32)  # by diagonal, the furthest place in a
    middle = most + 1
    reach[middle + 1] = 0
    trail: list[np.ndarray] = []
    for edits in range(most + 1):
        trail.append(reach[middle - edits - 1 : middle + edits + 2].copy())
        for k in range(-edits, edits + 1, 2):
            if k < -m or k > n:
                continue
            below, above = int(reach[middle + k - 1]), int(reach[middle + k + 1])
            x = above if k == -edits or (k != edits and below < above) else below + 1
            if x <= n and x - k <= m:
                x += run(x, x - k)
            reach[middle + k] = x
            if x >= n and x - k >= m:
                return walk_back(trail, edits, n, m)
    return None


def walk_back(trail: list[np.ndarray], edits: int, x: int, y: int) -> list[tuple[int, int, int]]:
    runs = []
    for e in range(edits, -1, -1):
        k, reach = x - y, trail[e]
        if e == 0:
            start_x = start_y = 0
        else:
            below, above = int(reach[e + k]), int(reach[e + k + 2])
            down = k == -e or (k != e and below < above)
            start_x, start_y = (above, above - k) if down else (below + 1, below + 1 - k)
        if x > start_x:
            runs.append((start_x, start_y, x - start_x))
        if e:
            x, y = (start_x, start_y - 1) if down else (start_x - 1, start_y)
    return runs[::-1]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shingles in aligned runs over all shingles of both texts (aligned ones once), from word hashes.

    The multiset overlap bounds it from above, and is looked at first; 0 means below the threshold.
    """
    if len(a) < WORDS or len(b) < WORDS:
        return float(len(a) == len(b) and bool((a == b).all()) and len(a) > 0)
    la, lb = labelled_shingles(a), labelled_shingles(b)
    total = len(la) + len(lb)
    need = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * total - 1e-9))
    if min(len(la), len(lb)) < need:
        return 0.0
    if len(np.intersect1d(la, lb, assume_unique=True)) < need:
        return 0.0
    runs = align(a, b, total - 2 * need)  # a word outside the runs spoils one shingle at least
    if runs is None:
        return 0.0
    aligned = sum(max(0, length - WORDS + 1) for _, _, length in runs)
    return aligned / (total - aligned)


def sketched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, n_words, keys) of every row; texts without words have null sketches."""
    hashes = WordHashes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [hashes.of(t.split()) for t in batch.column(3).to_pylist()]
            found = [sketch(w) if len(w) else None for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(map(len, words), pa.int64()),
                    pa.array([None if f is None else f.view(np.int64) for f in found], pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "key", "n_words", "keys"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("key"),
        binary_text().alias("text"),
    )
    return map_batches(rows, work, "row long, doc_id long, key binary, n_words long, keys array<long>")


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted texts; ``wanted`` (node, key, holder) names one document of each to fetch."""
    found = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    same = (found["key"] == wanted["key"]) & found["doc_id"].eqNullSafe(wanted["holder"])
    return found.join(wanted, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    both = (
        pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        .select("a", "b", "text_a", "text_b")
    )
    hashes = WordHashes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            near = [similarity(hashes.of(x.split()), hashes.of(y.split())) >= SIMILARITY for x, y in texts]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return map_batches(both, work, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of every set on the left with every one on the right, by products of 0-1 matrices."""
    both = left + right
    values, place = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    shared = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    owner, place = owner[shared[place]], number[place[shared[place]]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(shared.sum()), 4096):
        some = slice(*np.searchsorted(place, [low, low + 4096]))
        there = np.zeros((len(both), 4096), np.float32)
        there[owner[some], place[some] - low] = 1
        out += there[: len(left)] @ there[len(left) :].T
    return out


def links_across(table: pa.Table, hashes: WordHashes) -> pa.RecordBatch | None:
    """Links of one pair of blocks that join different classes, as a forest.

    Shingle similarities of all pairs are computed at once; pairs from the threshold on are aligned,
    the most similar first, unless links found so far have joined their classes. A pair that also
    shares an earlier sketch is left to that bucket.
    """
    own = table["own"].to_numpy()
    first, second = table["first"][0].as_py(), table["second"][0].as_py()
    band = table["band"][0].as_py()
    left = np.flatnonzero(own == first)
    right = left if first == second else np.flatnonzero(own == second)
    nodes = table["node"].to_pylist()
    classes = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
    keys = np.array(table["keys"].to_pylist(), np.int64)
    words = [hashes.of(t.split()) for t in table["text"].to_pylist()]
    sets = [labelled_shingles(w) for w in words]
    sizes = np.array([len(x) for x in sets])
    common = overlaps([sets[i] for i in left], [sets[i] for i in right])
    union = sizes[left][:, None] + sizes[right][None, :] - common
    similar = common / union
    open_pair = (similar >= SIMILARITY - 1e-6) & (classes[left][:, None] != classes[right][None, :])
    for t in range(band):
        open_pair &= keys[left, t][:, None] != keys[right, t][None, :]
    a, b = np.nonzero(open_pair)
    root = list(range(int(classes.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for at in np.argsort(-similar[a, b], kind="stable"):
        i, j = left[a[at]], right[b[at]]
        x, y = find(classes[i]), find(classes[j])
        if x != y and similarity(words[i], words[j]) >= SIMILARITY:
            root[max(x, y)] = min(x, y)
            found.append((nodes[i], nodes[j]))
    if not found:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, component_id, kept) of every row of ``docs`` (doc_id, text).

    Equal texts are one node. Nodes in one bucket, i.e. with an equal sketch, are first aligned
    with one node of the bucket, which joins groups of any size by as many pairs as members.
    Buckets whose nodes are still in different classes then go to tasks, in pairs of blocks, which find the
    links between classes and return a forest of them, never the pairs; so no link in a bucket is left out.
    A component is what links (similarity of at least 0.8) connect; ``component_id`` is its
    smallest doc_id, and exactly one row of it is kept: that with the smallest doc_id (null last),
    of repeated rows the first. Texts without words, null ones too, link with nothing and are kept.
    Texts of less than five words link with equal texts; very long ones are compared whole, within a band. ``row`` numbers the rows of one scan.
    """
    base = cut_lineage(sketched(docs))
    with_words = base.where("n_words > 0")
    nodes = (
        with_words.groupBy("key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("keeper"),
            F.first("keys").alias("keys"),
        )
        .select(F.col("keeper.row").alias("node"), "key", "keeper", "keys")
    )
    nodes = cut_lineage(nodes)
    buckets = nodes.select("node", F.posexplode("keys").alias("band", "bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    crowded = cut_lineage(buckets.join(heads, "bucket").select("bucket", "band", "node", "head"))
    holders = nodes.select("node", "key", F.col("keeper.doc_id").alias("holder"))
    texts = cut_lineage(fetched(docs, holders.join(crowded.select("node").distinct(), "node")))
    spokes = crowded.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = cut_lineage(verified(spokes, texts))
    classes = components(links)
    classed = crowded.join(classes, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rest = classed.join(mixed.select("bucket"), "bucket").join(nodes.select("node", "keys"), "node").join(texts, "node")
    rest = rest.select("bucket", "band", "node", "root", "keys", "text")
    hashes = WordHashes()
    more = pairs_in_groups(rest, "bucket", "node", lambda t: links_across(t, hashes), "a long, b long", BLOCK_TEXTS, BATCH_ROWS)
    more = cut_lineage(more.distinct())
    if not more.isEmpty():
        classes = components(links.union(more))
    member = nodes.select("node", "key", "keeper").join(classes, "node", "left")
    member = member.select("key", "keeper", F.coalesce("root", "node").alias("root"))
    keeper = member.groupBy("root").agg(F.min("keeper").alias("keeper"))
    placed = member.select("key", "root").join(keeper, "root").select("key", "keeper")
    return (
        base.select("row", "doc_id", "n_words", "key")
        .join(placed, "key", "left")
        .select(
            "row",
            "doc_id",
            F.when(F.col("n_words") > 0, F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            ((F.col("n_words") == 0) | (F.col("keeper.row") == F.col("row"))).alias("kept"),
        )
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The kept rows of ``near_duplicates``, with all their columns, whatever their names.

    Rows are told apart by id and text; of rows that repeat both, which are one document, one stays
    if it is in a group and all stay if they have no words.
    """
    found = near_duplicates(docs)
    chosen = found.where("kept").select("row")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document"))
    return numbered.join(chosen, "row", "left_semi").select("document.*")
