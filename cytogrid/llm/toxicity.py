"""Toxicity scores from bags of subwords averaged into a linear softmax."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import BATCH_ROWS, binary_text, fold, forget, map_batches, new_words

#: Words of a bag; a text is as toxic as its most toxic bag.
WINDOW = 64
#: Bound of the training sample, documents of either class, taken by a hash of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3500
#: Bags of a training document, evenly spaced (scores read every bag).
SAMPLE_BAGS = 16
BUCKETS, SHORTEST, LONGEST = 1 << 18, 3, 5
DIMENSIONS, EPOCHS, BATCH, RATE, SHRINK, LEAST_STEPS = 8, 5, 128, 1.0, 0.4, 150
THRESHOLD = 0.3


def subwords(word: bytes) -> list[int]:
    """Hashed character n-grams of a word between its edges, and the word itself."""
    text = f"<{word.decode('utf-8', 'replace').lower().strip('.,;:!?')}>"
    grams = {text} | {text[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(text) - n + 1)}
    return sorted(zlib.crc32(g.encode()) % BUCKETS for g in grams)


def bag_starts(words: int) -> np.ndarray:
    """Starts of bags side by side; the last one ends with the text."""
    if words <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, words, WINDOW)
    starts[-1] = words - WINDOW
    return starts


@dataclass
class Model:
    """Two classes need one number per subword: the difference of its two logits."""

    weight: np.ndarray
    bias: float
    scale: float


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def train(bags: list[bytes], owners: np.ndarray, labels: np.ndarray, seed: int = 1) -> Model:
    """Embeddings and softmax by stochastic gradient descent; bags of one owner share its label.

    Steps shrink with the squared gradients that a subword has had, counted from 1: frequent
    subwords settle, and one seen once or twice hardly moves. Each fifth of the training ends with a soft
    threshold, which takes back what single bags have left on their other words.

    A toxic text need not be toxic throughout: after an epoch over all bags, the bag with
    the highest score speaks for its toxic text, and clean texts are held by their highest bags and one
    other. An empty bag is a clean one.
    """
    vocabulary: dict[bytes, int] = {}
    labels = np.append(labels, 0).astype(np.int64)
    owners = np.append(owners, owners.max(initial=-1) + 1)
    words, lengths, grams, sizes = array("i"), array("i"), array("i"), array("i")  # far smaller than lists
    for bag in (*bags, b""):
        split = bag.split()
        lengths.append(len(split))
        words.extend(vocabulary.setdefault(w, len(vocabulary)) for w in split)
    for word in vocabulary:
        found = subwords(word)
        sizes.append(len(found))
        grams.extend(found)
    del vocabulary
    word_ids, word_counts, gram_counts = (np.array(x, np.int32) for x in (words, lengths, sizes))
    word_starts, gram_starts = np.cumsum(word_counts) - word_counts, np.cumsum(gram_counts) - gram_counts
    used, flat = np.unique(np.array(grams, np.int32), return_inverse=True)
    flat = flat.astype(np.int32)
    rng = np.random.default_rng(seed)
    scale = float(WINDOW)
    params = [
        rng.normal(0, 0.01, (len(used), DIMENSIONS)).astype("f4"),
        rng.normal(0, 0.5, (DIMENSIONS, 2)).astype("f4"),
        np.array([2, -2], "f4"),  # most bags are clean
    ]
    had = [np.ones_like(p) for p in params]

    def gather(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subwords of the bags, the bag of each, and the counts of subwords."""
        words = word_ids[ranges(word_starts[chosen], word_counts[chosen])]
        bag_of_word = np.repeat(np.arange(len(chosen)), word_counts[chosen])
        return (
            flat[ranges(gram_starts[words], gram_counts[words])],
            np.repeat(bag_of_word, gram_counts[words]),
            np.bincount(bag_of_word, gram_counts[words], len(chosen)),
        )

    def difference(chosen: np.ndarray) -> np.ndarray:
        scalar = params[0] @ (params[1][:, 1] - params[1][:, 0])
        out = np.empty(len(chosen))
        for at in range(0, len(chosen), 1024):
            ids, bag, counts = gather(chosen[at : at + 1024])
            sums = np.bincount(bag, scalar[ids], len(counts))
            out[at : at + 1024] = sums / np.maximum(counts, 1) * scale + params[2][1] - params[2][0]
        return out

    everything = np.arange(len(lengths))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(lengths)))  # a small sample is gone through more often
    for epoch in range(epochs):
        chosen = everything
        if epoch >= 1:
            order = np.lexsort((-difference(everything), owners))
            top = np.r_[True, owners[order][1:] != owners[order][:-1]]
            second_best = np.r_[False, top[:-1]] & ~top
            some = rng.random(len(order)) < 0.15
            keep = top | ((labels[order] == 0) & (second_best | some))
            chosen = order[keep]
        chosen = np.append(rng.permutation(chosen), np.full(8, len(lengths) - 1))
        for at in range(0, len(chosen), BATCH):
            part = chosen[at : at + BATCH]
            ids, bag, counts = gather(part)
            share = (scale / np.maximum(counts, 1)).astype("f4")
            mean = np.stack([np.bincount(bag, params[0][ids, k], len(part)) for k in range(DIMENSIONS)], 1) * share[:, None]
            logits = mean @ params[1] + params[2]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(part)), labels[part]] -= 1
            error = prob.astype("f4")
            back = (error @ params[1].T) * share[:, None]
            touched, place = np.unique(ids, return_inverse=True)
            rows = np.stack([np.bincount(place, back[bag, k], len(touched)) for k in range(DIMENSIONS)], 1)
            rate = RATE * (1 - (at / len(chosen) + epoch) / epochs)
            for k, (where, grad) in enumerate([(touched, rows), (slice(None), mean.T @ error), (slice(None), error.sum(0))]):
                had[k][where] += grad**2
                params[k][where] -= rate * grad / np.sqrt(had[k][where])
        if (epoch + 1) * EPOCHS // epochs == epoch * EPOCHS // epochs:
            continue
        scalar = params[0] @ (params[1][:, 1] - params[1][:, 0])
        params[0] *= np.maximum(0, 1 - SHRINK / np.maximum(np.abs(scalar), 1e-9))[:, None].astype("f4")
    weight = np.zeros(BUCKETS)
    weight[used] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    return Model(weight, float(params[2][1] - params[2][0]), scale)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def score(self, texts: list[bytes]) -> list[float]:
        forget(self.cache)
        split = [t.split() for t in texts]
        for word in new_words(split, self.cache):
            ids = subwords(word)
            self.cache[word] = complex(self.model.weight[ids].sum(), len(ids))
        return [self.highest(np.fromiter(map(self.cache.__getitem__, ws), complex, len(ws))) for ws in split]

    def highest(self, words: np.ndarray) -> float:
        """The softmax of the highest bag; ``words``: sum of weights and count of subwords of each."""
        sums = np.append(0, np.cumsum(words))
        starts = bag_starts(len(words))
        bags = sums[np.minimum(starts + WINDOW, len(words))] - sums[starts]
        logit = float((bags.real / np.maximum(bags.imag, 1)).max()) * self.model.scale + self.model.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def sample_bags(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bags of a bounded sample of labelled training rows, with their document and label."""
    training = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", 4) != 2))
    training = training.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [
        training.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        for label, bound in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # of a fixed number of ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                starts = bag_starts(len(words))
                for i in sorted({int(x) for x in np.linspace(0, len(starts) - 1, SAMPLE_BAGS)}):
                    for column, value in zip(out, (doc_id, toxic, b" ".join(words[starts[i] : starts[i] + WINDOW])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "toxic", "bag"])

    bags = map_batches(rows.join(sample, "doc_id"), work, "doc_id long, toxic int, bag binary").toArrow().sort_by(
        [("doc_id", "ascending"), ("bag", "ascending")]
    )
    return bags["bag"].to_pylist(), bags["doc_id"].to_numpy(), bags["toxic"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns on the driver from a bounded sample; without any usable row every score is 0."""
    bags, owners, toxic = sample_bags(docs, labels)
    if not len(bags) or not toxic.any():
        return Model(np.zeros(BUCKETS), -700.0, 1.0)
    return train(bags, owners, toxic)


def scoring_udf(docs: DataFrame, model: Model):
    """A pandas function from the text's bytes to its score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shipped.value)
        for part in parts:
            yield pd.Series(scorer.score(part.tolist()), dtype="float64")

    return F.pandas_udf(score, "double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, whatever their names.

    Learns from the labelled training rows among ``docs``. Rows are judged one by one, repeated ones alike; a null
    or empty text has the score of an empty bag.
    """
    score = scoring_udf(docs, fit(docs, labels))
    return docs.where(score(binary_text()) < THRESHOLD)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels of the held-out fold (crc32 of the id modulo 4 is 2) are never learned from. Null
    ids count as not held out; labels other than 0 and 1, or without an id, are left out; a document with
    both labels counts as toxic. A null or empty text has the score of an empty bag; every bag of a very long text is
    scored, by one task. Repeated rows and other columns do no harm; an empty table gives no rows.
    """
    score = scoring_udf(docs, fit(docs, labels))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(binary_text()).alias("score")).select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
