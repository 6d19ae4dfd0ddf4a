"""Ranked search against plain scoring, with segments and blocks of items cut at different sizes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose

from cytogrid.llm import block_lists, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items, k):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    n_docs, n_terms = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in cut:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in wanted & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i, score))
        best = sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k]
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(best, 1)]
    return Counter(out)


def rows_of(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("segment, postings, block_terms", [(16_384, 2_000_000, 200_000), (40, 10**9, 60), (10**9, 150, 200_000)])
def test_matches_plain_scores(spark, edge_rows, monkeypatch, segment, postings, block_terms):
    rng = random.Random(6)
    docs = [(i, prose(rng, int(2 ** rng.uniform(0, 9)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [*edge_rows, (9001, "漢字 ÀÉÎ x²"), (9002, "a_b 12")]
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(25)]
    items += [(50, None), (51, "  ;; "), (52, "漢字 à x² b b B"), (53, docs[3][1]), (2, "ba be bi"), (None, "da de")]
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(block_lists, "SPAN", 64)
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, term int").repartition(3)
    found = lexical.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert rows_of(found) == plain(docs, items, 7)


def test_empty_tables(spark, no_docs):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert lexical.rank_documents(no_docs, items).count() == 0
    assert lexical.rank_documents(docs, items.where("false")).count() == 0
    assert lexical.rank_documents(docs, items).collect()[0]["doc_id"] == 1


def test_blocks_round_trip_and_bound():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 4000, 5000)
    docs = np.sort(rng.choice(5000, 700, replace=False))
    tf = rng.geometric(0.3, 700)
    tf[5] = 70_000
    postings = block_lists.PostingList(**block_lists.encode(docs, tf, lengths), weight=700, n_docs=5000, n_terms=int(lengths.sum()))
    base = 20 * (50 + (50 * lengths * 5000) // int(lengths.sum()))
    opened = [postings.open(i, base) for i in range(len(postings.first))]
    assert (np.concatenate([d for d, _ in opened]) == docs).all()
    scores = 700 * ((1_000_000_000 * tf) // (1000 * tf + base[docs]))
    assert (np.concatenate([s for _, s in opened]) == scores).all()
    assert [int(s.max()) for _, s in opened] == postings.highest.tolist()


def test_blocks_below_the_limit_stay_closed():
    lengths = np.full(40_000, 100)
    rare, common = np.array([3, 70, 20_000]), np.arange(0, 40_000, 2)
    lists = [
        block_lists.PostingList(**block_lists.encode(d, np.ones(len(d), int), lengths), weight=w, n_docs=40_000, n_terms=4_000_000)
        for d, w in ((rare, 9000), (common, 600))
    ]
    best = block_lists.Best(2)
    block_lists.search(lists, 20 * (50 + (50 * lengths * 40_000) // 4_000_000), np.arange(40_000), best)
    assert best.ids.tolist() == [70, 20_000] and len(lists[1].opened) < len(lists[1].first) / 10
