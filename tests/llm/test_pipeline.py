"""The pipeline's stages on a small corpus, each against the operator that it calls."""

import random

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from cytogrid.llm import near_duplicates, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(17)
    shared = prose(rng, 70)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(320)]
    for i in range(0, 240, 4):
        texts[i] += " grumbold snarfel" * 4  # toxic
    for i in range(1, 240, 4):
        texts[i] = " ".join(w + "###" for w in texts[i].split())  # low quality
    copy = texts[250].split()
    copy[5] = "changed"
    texts += [" ".join(copy), texts[251], f"{prose(rng, 60)} {shared} {prose(rng, 30)}", f"{prose(rng, 50)} {shared}", "too short", None, ""]
    labels = [(i, int(i % 4 != 1 or i >= 240), int(i % 4 == 0 and i < 240)) for i in range(320) if i % 3]
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(enumerate(texts))


def test_stages(spark, corpus):
    folder, texts = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.columns == COLUMNS, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic, quality, near, passages = kept
    gone = set(texts) - set(toxic)
    assert len(gone & set(range(0, 240, 4))) >= 55 and len(gone - set(range(0, 240, 4))) <= 8
    low = {i for i in toxic if not texts[i] or len(texts[i].split()) < 50} | set(range(1, 240, 4)) & set(toxic)
    assert set(toxic) - set(quality) == low
    copies = {i for i, j in ((320, 250), (321, 251)) if {i, j} <= set(quality)}
    assert set(quality) - set(near) == copies
    changed = {i for i in near if passages.get(i) != near[i]}
    assert len(changed) == int({322, 323} <= set(near)) and changed <= {322, 323} and set(passages) == set(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    want = packing.pack(docs, with_ids=False)
    assert pieces.groupBy().sum("length").first()[0] == want.groupBy().sum("length").first()[0]
    assert {r.doc_id for r in pieces.collect()} == set(passages)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces.collect())


def test_registered():
    names = contract.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) >= 10
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in contract.oracle_sql()
    numbers = {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}
    assert numbers == set(range(1, 14))


def test_stages_take_any_rows(spark, tmp_path, edge_docs, edge_rows):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named as operators name their own."""
    labels = [(5, 1, 0), (8, 1, 0), (8, 1, 0), (3, 0, None), (None, 0, 1), (99, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, folder = edge_docs, str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.columns == edge_docs.columns and {(r.row, r.key, r.id) for r in docs.collect()} <= {(1, "a", "z")}, name
        if name == "toxicity":  # no text here is labelled toxic
            assert sorted(map(tuple, docs.select("doc_id", "text").collect()), key=str) == sorted(edge_rows, key=str)
        if name == "quality_rules":  # the very long text and three copies of one have 50 words
            assert sorted(r.doc_id for r in docs.collect()) == [5, 8, 8, 8]
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == [5, 8]
    assert {r.doc_id: r.text for r in docs.collect()} == {5: edge_rows[5][1], 8: edge_rows[8][1]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    sums = {r.doc_id: (r.n, r.whole) for r in pieces.groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()}
    assert set(sums) == {5, 8} and all(n == whole for n, whole in sums.values())


def test_stages_take_empty_tables(spark, corpus, no_docs, tmp_path):
    spark.read.parquet(f"{corpus[0]}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for labels in (corpus[0], str(tmp_path)):
        docs = no_docs
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut_lineage(stage(spark, docs, labels))
            assert docs.count() == 0, name


def test_near_duplicates_of_long_texts_stay_small():
    rng = random.Random(2)
    hashes = near_duplicates.WordHashes()
    text = prose(rng, 30_000).split()
    other = text[:9000] + prose(rng, 40).split() + text[9000:]
    a, b = (hashes.of([w.encode() for w in t]) for t in (text, other))
    assert near_duplicates.similarity(a, b) > 0.99
    assert near_duplicates.similarity(a, np.roll(b, 15_000)) < 0.8
