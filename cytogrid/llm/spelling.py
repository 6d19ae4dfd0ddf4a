"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted or deleted letter changes the vector of a word's letter counts by 1 in the sum of absolute differences,
one replaced letter by 2 at most. So the words near a word of length l are searched in trees of the words of length l
(within 2) and l + 1 (within 1): branches whose box is farther away are pruned, what is left is verified letter by
letter. Both sides of a pair of different lengths are credited at once, so each is searched once.

The trees are spread over tasks. A router, a tree over a bounded sample of words, cuts the vectors of one length into
leaves; each word lies in one leaf and asks in every leaf its ball reaches. Each task builds the tree of its leaf and
gives sums for each word, never pairs. Leaves that came out larger than planned are dealt in blocks of words and
askers. The sample places the cuts only, results do not depend on it.

Defined results: no text has no words; a null id counts as an empty one in the hash of a run; repeated rows count
as often as they stand there; ties between forms go to the word that is first in code-point order; very long texts and
words of any length are taken whole; no row of ``documents`` gives no row. Columns but id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.functions.skew import attach
from cytogrid.llm.blocks import groups
from cytogrid.llm.common import slices
from cytogrid.llm.letter_tree import LetterTree, letter_counts
from cytogrid.session import cut_lineage

#: Fixed values of the word rule.
RUN = re.compile("[a-zÀ-ÿ]{6,}")
LEAST_LETTERS, LEAST_COUNT, SLIP, RATIO = 6, 5, 199, 5
#: Distinct words a worker counts before it passes them on.
HELD_WORDS = 300_000
#: Letters of the words in one leaf, on average, and words the router is drawn from.
LEAF_LETTERS, SAMPLE_WORDS = 150_000, 100_000
#: Askers handled at a time in a task, in leaves' worths.
ASKERS = 4


def words_of(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of one text that may count, with their numbers; some runs lose a letter, by their hash."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes.lower changes A-Z alone
        slip = zlib.crc32(run.encode(), start)
        if slip % SLIP == 0:
            at = slip % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        yield run, n


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): all words with enough letters and occurrences; counts are added up inside tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for doc_id, body in zip(batch[0].to_pylist(), batch[1], strict=True):
                for word, n in words_of(doc_id, body.as_py()):
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield passed_on()
                    held = Counter()
        yield passed_on()

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    counted = docs.select(F.col(key).cast("long"), body).mapInArrow(slices(count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def leaf_words(length: int) -> int:
    return max(64, LEAF_LETTERS // length)


def routers(words: DataFrame) -> dict[int, LetterTree]:
    """A tree for every length with more words than a leaf takes, from a sample drawn by hash."""
    sizes = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("words"))
    large = {r["length"]: r["words"] for r in sizes.where(F.col("words") > F.greatest(
        F.lit(64), F.floor(F.lit(LEAF_LETTERS) / F.col("length")))).collect()}
    if not large:
        return {}
    every = -(-sum(large.values()) // SAMPLE_WORDS)
    drawn = words.where(F.length("word").isin(list(large)) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word")
    by_length: dict[int, list[str]] = {length: [] for length in large}
    for row in drawn.collect():
        by_length[len(row["word"])].append(row["word"])
    return {
        length: LetterTree(letter_counts(sample), len(sample) * leaf_words(length) / large[length], whole=True)
        for length, sample in by_length.items()
        if sample
    }


def route(words: DataFrame, trees: dict[int, LetterTree]) -> DataFrame:
    """(length, leaf, asks, word, n): each word once where it lies, and once in each leaf it asks in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["word"].to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            vectors = letter_counts(texts)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                for target, asks, radius in ((length, False, 0), (length, True, 2), (length + 1, True, 1)):
                    tree = trees.get(int(target))
                    if tree is None:
                        found = [(0, mine)]
                    else:
                        found = ((leaf, mine[rows]) for leaf, rows in tree.search(vectors[mine], radius))
                    for leaf, rows in found:
                        taken = batch.take(pa.array(rows))
                        yield pa.record_batch({
                            "length": pa.array(np.full(len(rows), target, np.int32)),
                            "leaf": pa.array(np.full(len(rows), leaf, np.int32)),
                            "asks": pa.array(np.full(len(rows), asks)),
                            "word": taken["word"],
                            "n": taken["n"],
                        })

    return words.mapInArrow(place, "length int, leaf int, asks boolean, word string, n long")


def deal(placed: DataFrame) -> DataFrame:
    """Adds ``block``: pairs of a block of words and a block of askers, each of bounded size, in leaves that need it."""
    leaf = ["length", "leaf"]
    planned = F.greatest(F.lit(64), F.floor(F.lit(LEAF_LETTERS) / F.col("length")))
    sizes = placed.groupBy(*leaf).agg(
        F.count(F.when(~F.col("asks"), 1)).alias("_words"), F.count(F.when(F.col("asks"), 1)).alias("_askers")
    )
    sizes = sizes.where("_words > 0 AND _askers > 0").select(
        *leaf,
        F.ceil(F.col("_words") / (2 * planned)).alias("_parts"),
        F.ceil(F.col("_askers") / (ASKERS * planned)).alias("_turns"),
    )
    own = F.xxhash64("word")
    parts = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(own, F.col(n)))
    return (
        attach(placed, sizes, leaf, ["word"])
        .withColumn("_part", F.explode(F.when(F.col("asks"), parts("_parts")).otherwise(one("_parts"))))
        .withColumn("_turn", F.explode(F.when(F.col("asks"), one("_turns")).otherwise(parts("_turns"))))
        .select(*leaf, (F.col("_part") * F.col("_turns") + F.col("_turn")).alias("block"), "asks", "word", "n")
    )


def letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one letter: replaced at equal lengths, else one more in ``long``."""
    length = short.shape[1]
    if long.shape[1] == length:
        return (short != long).sum(axis=1) == 1
    lead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return lead + tail >= length


def search_leaf(table: pa.Table) -> pa.RecordBatch | None:
    """For the words of one block of a leaf and their askers: how many are near, and the best of them, per word."""
    asks = table["asks"].to_numpy()
    order = np.argsort(asks, kind="stable")
    table, held = table.take(pa.array(order)), int((~asks).sum())
    texts, counts = table["word"].to_pylist(), table["n"].to_numpy()
    if not held or held == len(texts):
        return None
    length = len(texts[0])
    words = letters(texts[:held], length)
    tree = LetterTree(letter_counts(texts[:held]), 32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    near_a, near_b = [], []
    for size, radius in ((length, 2), (length - 1, 1)):
        mine = np.flatnonzero((sizes == size) & (np.arange(len(texts)) >= held))
        if not len(mine):
            continue
        asked = letters([texts[i] for i in mine], size)
        for asker, word in tree.pairs(letter_counts([texts[i] for i in mine]), radius):
            good = one_edit(asked[asker], words[word])
            a, b = mine[asker[good]], word[good]
            near_a.append(a)
            near_b.append(b)
            if size < length:  # the longer word does not ask for shorter ones
                near_a.append(b)
                near_b.append(a)
    if not near_a:
        return None
    mine, other = np.concatenate(near_a), np.concatenate(near_b)
    if not len(mine):
        return None
    rank = np.empty(len(texts), np.int64)  # code-point order, with which ties are decided
    rank[np.array(sorted(range(len(texts)), key=texts.__getitem__))] = np.arange(len(texts))
    by = np.lexsort((rank[other], -counts[other], mine))
    mine, other = mine[by], other[by]
    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
    number = np.diff(np.r_[first, len(mine)])
    return pa.record_batch({
        "word": table["word"].take(pa.array(mine[first])).combine_chunks(),
        "n_near": pa.array(number),
        "best_n": pa.array(counts[other[first]]),
        "best": table["word"].take(pa.array(other[first])).combine_chunks(),
    })


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of every word that has a near one."""
    placed = cut_lineage(route(words, routers(words)))
    key = ["length", "leaf", "block"]
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = deal(placed).repartition(parts, *key).sortWithinPartitions(*key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, len(key)):
            found = search_leaf(table)
            if found is not None:
                yield found

    found = dealt.mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", F.col("_best.word").alias("best"), (-F.col("_best.n")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last one. Steps double, and each form is five times its word or more."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        up = steps.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        jumped = cut_lineage(attach(steps, up, ["root"], ["word"], "left"))
        steps = jumped.select("word", F.coalesce("_up", "root").alias("root"))
        if jumped.where("_up IS NOT NULL").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``form``, the commoner word it is a variant of, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = cut_lineage(count_words(docs, key, text))
    is_form = F.col("best_n") >= RATIO * F.col("n")
    judged = cut_lineage(
        words.join(near_words(words), "word", "left").select(
            "word",
            F.when(is_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(judged.where("form IS NOT NULL"))
    found = judged.join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
