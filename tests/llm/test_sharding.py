"""Shards, against sums worked out in plain Python."""

import random
import zlib
from collections import Counter

import pytest
from conftest import prose

from cytogrid.llm import sharding


def sizes_of(rows):
    totals = Counter()
    for r in rows:
        totals[r["shard"]] += r["size"]
    return totals


def check(rows, docs, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    longest, total = max(r["size"] for r in rows), sum(r["size"] for r in rows)
    sizes = sizes_of(rows)
    assert all(abs(sizes[s] - total / shards) <= longest for s in range(shards))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


@pytest.mark.parametrize("by", ["text", "id"])
@pytest.mark.parametrize("shards", [1, 3, 8, 50])
def test_edges(spark, edge_docs, edge_rows, by, shards):
    check(sharding.shard_documents(edge_docs, shards, by=by).collect(), edge_rows, shards)


def test_groups_and_hot_texts(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(120)]
    texts += [texts[i % 7] for i in range(60)] + [prose(rng, 10)] * 200 + [prose(rng, 400)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    found = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    check(found, docs, 8)
    longest = max(r["size"] for r in found)
    groups = {}
    for r in found:
        groups.setdefault(r["text_crc32"], []).append(r)
    for members in groups.values():
        if sum(r["size"] for r in members) <= longest:
            assert len({r["shard"] for r in members}) == 1
    hot = max(groups.values(), key=len)
    assert sum(r["size"] for r in hot) > 2 * longest and len({r["shard"] for r in hot}) > 1


def test_order_by_id_is_contiguous(spark):
    docs = [(i, "x" * (i * 37 % 101)) for i in range(300)]
    found = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), by="id").collect()
    placed = sorted((r["shard"], r["slot"], r["doc_id"]) for r in found)
    assert [p[2] for p in placed] == list(range(300))


def test_empty_table(no_docs):
    found = sharding.shard_documents(no_docs)
    assert found.count() == 0 and found.columns[:2] == ["doc_id", "size"]


def test_written_shards_hold_the_texts(spark, tmp_path):
    docs = [(i, f"text {i} " * (i % 9)) for i in range(100)]
    sharding.write_shards(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == docs
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(4)}
