"""Ranked lexical search: Block-Max MaxScore over segments of documents.

Every document is indexed once per block of items: tasks read whole texts, keep the postings of the items' terms, and
write segments of bounded size, a row per term with its compressed blocks and one with the documents' lengths. The
collection's statistics are sums over these rows. Segments are then searched by whole tasks, which carry their best
documents per item from one segment to the next; what the tasks found is ranked in the end.

Items are dealt into blocks by a hash, so that the terms sent to each task stay below ``BLOCK_TERMS`` on average
however many items there are; each block of items takes one pass over all documents.

Defined results: texts that are null or without a term belong to no statistic and are found by no item; items
without terms have no rows; rows of one item id are one item; each of several rows with one document id is a document
of its own; documents without an id come last among equal scores. Texts are read whole, whatever their length. Columns
but ids and texts are not read, and an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytogrid.llm.block_lists import LENGTH, FLAT, SLOPE, Best, PostingList, encode, search
from cytogrid.llm.blocks import groups
from cytogrid.llm.common import binary_text, slices
from cytogrid.session import cut_lineage

TOP = 50
#: Distinct pairs of item and term that one pass over the documents serves.
BLOCK_TERMS = 200_000
#: A segment ends with the document that brings it to one of these.
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 2_000_000
#: Stands for a missing id; the contract's ids are smaller.
NO_ID = (1 << 63) - 1
SEGMENT = "segment long, term int, df long, heads binary, payload binary, tops binary"
#: Letters, digits and everything beyond ASCII make up terms; only A-Z change.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of every item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set(terms_of(t.as_py())) for t in batch[1]]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            terms = pa.array([t for x in found for t in x], pa.binary())
            yield pa.record_batch({"item": batch[0].take(pa.array(at, pa.int64())), "term": terms})

    kept = items.select(F.col(key).cast("long").alias("item"), binary_text(text))
    return kept.mapInArrow(slices(split), "item long, term binary").distinct()


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """The segments: a row per term, and one with term -1 for ids (heads), lengths (payload) and their sum (df)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        lengths: list[int] = []
        postings: dict[int, tuple[list[int], list[int]]] = {}
        held = 0

        def done() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            length = np.array(lengths, np.int64)[order]
            rows = [{
                "segment": segment, "term": -1, "df": int(length.sum()), "tops": b"",
                "heads": np.array(ids, "<i8")[order].tobytes(), "payload": length.astype("<i8").tobytes(),
            }]
            for term, (docs_of, tf) in postings.items():
                at = place[docs_of]
                by = np.argsort(at)
                rows.append({"segment": segment, "term": term, "df": len(at), **encode(at[by], np.array(tf)[by], length)})
            names = ("segment", "term", "df", "heads", "payload", "tops")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch({c: pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)})

        for batch in batches:
            for doc_id, body in zip(batch[0].to_pylist(), batch[1], strict=True):
                words = terms_of(body.as_py())
                if not words:
                    continue
                found = Counter(map(terms.get, words))
                found.pop(None, None)
                for term, tf in found.items():
                    mine = postings.get(term)
                    if mine is None:
                        mine = postings[term] = [], []
                    mine[0].append(len(ids))
                    mine[1].append(tf)
                ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(len(words))
                held += len(found)
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_POSTINGS:
                    yield done()
                    ids, lengths, postings, held, segment = [], [], {}, 0, segment + 1
        if ids:
            yield done()

    return docs.select(F.col(key).cast("long"), binary_text(text)).mapInArrow(slices(index), SEGMENT)


def search_index(
    index: DataFrame, items: dict[int | None, list[int]], weights: dict[int, int], n_docs: int, n_terms: int, k: int
) -> DataFrame:
    """(item, doc, score): the best ``k`` of every item among the segments each task has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in items}
        for segment in groups(batches, 1):
            names = ("term", "heads", "payload", "tops")
            rows = {term: rest for term, *rest in zip(*(segment[c].to_pylist() for c in names), strict=True)}
            ids, length, _ = rows.pop(-1)
            ids, length = np.frombuffer(ids, "<i8"), np.frombuffer(length, "<i8")
            base = LENGTH * (100 - FLAT + (SLOPE * length * n_docs) // n_terms)
            lists = {t: PostingList(*parts, weights[t], n_docs, n_terms) for t, parts in rows.items()}
            for item, wanted in items.items():
                search([lists[t] for t in wanted if t in lists], base, ids, best[item])
        for item, found in best.items():
            size = len(found.ids)
            yield pa.record_batch({
                "item": pa.array([item] * size, pa.int64()), "doc": pa.array(found.ids), "score": pa.array(found.scores),
            })

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.repartition(parts, "segment").sortWithinPartitions("segment")
    return placed.mapInArrow(work, "item long, doc long, score long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP,
    key: str = "doc_id", item_key: str = "item_id", text: str = "text",
) -> DataFrame:
    """Each item's ``k`` best documents: item id, ``rank``, document id, ``score``."""
    asked = cut_lineage(item_terms(items, item_key, text))
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = []
    for block in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if not pairs:
            continue
        terms = {term: i for i, term in enumerate(sorted({bytes(r["term"]) for r in pairs}))}
        index = cut_lineage(build_index(docs, terms, key, text))
        per_term = index.groupBy("term").agg(
            F.sum("df").alias("df"), F.sum(F.when(F.col("term") < 0, F.octet_length("heads") / 8)).cast("long").alias("n")
        )
        sums = {r["term"]: (r["df"], r["n"]) for r in per_term.collect()}  # a row for each term asked for
        if -1 not in sums:
            continue
        n_terms, n_docs = sums.pop(-1)
        weights = {term: weight(n_docs, df) for term, (df, _) in sums.items()}
        wanted: dict[int | None, list[int]] = {}
        for row in pairs:
            wanted.setdefault(row["item"], []).append(terms[bytes(row["term"])])
        found.append(search_index(index, wanted, weights, n_docs, n_terms, k))
    schema = "item long, doc long, score long"
    every = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    ranked = every.withColumn("rank", place).where(F.col("rank") <= k)
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return ranked.select(F.col("item").alias(item_key), "rank", doc.alias(key), "score")
