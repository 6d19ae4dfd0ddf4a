"""Learned operators: held-out results, bounds, and brute force for what they count."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from cytogrid.llm import attention, language_model, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INSULTS = ["grumbold", "snarfel", "blightok"]


def misspelt(rng, word):
    at = rng.randrange(1, len(word) - 1)
    return word[:at] + rng.choice("aeiouxz") + word[at + 1 :]


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = prose(rng, rng.randint(5, 300)).split()
        label = int(i % 5 == 0)
        if label:
            for _ in range(1 + len(words) // 60):
                insult = rng.choice(INSULTS)
                words.insert(rng.randrange(len(words)), misspelt(rng, insult) if rng.random() < 0.5 else insult)
        rows.append((i, " ".join(words), label))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_on_held_out_rows(toxic):
    docs, labels = toxic
    held = [r for r in toxicity.score_documents(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in held} == {2}
    assert np.mean([r.predicted for r in held if r.toxic]) >= 0.9
    assert np.mean([r.predicted for r in held if not r.toxic]) <= 0.08  # few syllables, so clean words share n-grams


def test_toxicity_labels_of_the_held_out_fold_are_not_read(toxic):
    docs, labels = toxic
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1).otherwise(F.col("toxic")))
    assert toxicity.score_documents(docs, labels).collect() == toxicity.score_documents(docs, turned).collect()


def test_toxicity_edge_cases(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 1), (None, 1), (5, None), (9, 7)], "doc_id long, toxic int")
    found = toxicity.score_documents(edge_docs, labels).collect()
    assert len(found) == len(edge_rows) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_documents(edge_docs, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.score_documents(no_docs, labels).count() == 0
    kept = toxicity.without_toxic(edge_docs, labels.where("false"))
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_quality_counts(spark, edge_rows):
    rng = random.Random(6)
    texts = [t for _, t in edge_rows if t is None or len(t) < 10_000]
    texts += ["\n".join(" ".join(rng.choices("a b c d# é|".split(), k=rng.randint(0, 9))) for _ in range(12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeat = plain_counts(t)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat), t
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed)


def test_many_different_words_do_not_overflow():
    codes = np.r_[np.arange(1_500_000), np.arange(1_499_990, 1_500_000)]
    assert quality_rules.repeated_words(codes, 1_500_000) == 20


def test_rules_are_learned_and_pruned(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        words = prose(rng, rng.randint(60, 200)).split()
        low = i % 4 == 0
        if low:
            words = [w + rng.choice(["###", "***"]) for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(not low) if i % 97 else int(low)))  # some labels are wrong
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert 1 <= len(rules) <= 4 and all(len(r.conditions) <= 2 for r in rules), list(map(str, rules))
    found = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(found[i].kept for i in range(900) if i % 4)
    assert sum(not found[i].kept for i in range(0, 900, 4)) >= 220  # of 225; wrong labels hide the rest
    assert quality_rules.passing(docs, labels).count() == sum(r.kept for r in found.values())
    assert {found[i].rule for i in range(900) if i % 4 == 0} <= {None, 1, 2, 3, 4}
    for i, text, _ in rows:  # the list read from the top, in plain Python
        counts = dict(zip(quality_rules.COUNTS, quality_rules.count_statistics(text.encode()), strict=True))
        first = None
        for place, rule in enumerate(rules, 1):
            worth = {n: counts[o] / max(counts[u], 1) for n, o, u in quality_rules.RATIOS}
            if first is None and all((worth[c.statistic] > c.threshold) == c.above for c in rule.conditions):
                first = place
        assert found[i].rule == first and found[i].kept == (first is None)


def test_quality_edge_cases(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 1), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality_rules.judge(edge_docs, labels).count() == len(edge_rows)
    assert quality_rules.judge(no_docs, labels).count() == 0
    kept = quality_rules.passing(edge_docs, labels)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 8, 8, 8]


@pytest.fixture(scope="module")
def fewer_steps():
    before = language_model.STEPS
    language_model.STEPS = 60
    yield
    language_model.STEPS = before


def test_language_model_counts_and_scores(spark, fewer_steps, monkeypatch):
    monkeypatch.setattr(language_model, "TOP_WORDS", 50)  # most words come from the join
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(150)] + [None, "", "A a B c", "<|endoftext|> x"] * 2
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    found = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    counts = {}
    for ts, h in zip(tokens, held, strict=True):
        for t in [] if h else ts:
            counts[t] = counts.get(t, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for i, ts in enumerate(tokens):
        r = found[i]
        base = math.fsum(math.log10((counts.get(t, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ts), total)
        assert r.n_known == sum(t in counts for t in ts) and abs(r.base_score - base) < 1e-8
        assert r.score < 0 and math.isfinite(r.score)


def test_scores_use_the_counts_of_all_words(spark, fewer_steps, monkeypatch):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(120)] + [None, "", "A a", "<|endoftext|> x"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {}
    for bound in (50, 200_000):
        monkeypatch.setattr(language_model, "TOP_WORDS", bound)
        scores[bound] = {r.doc_id: r.score for r in language_model.score_documents(docs).collect()}
    assert scores[50] == pytest.approx(scores[200_000], rel=1e-5)


def test_language_model_edge_cases(spark, fewer_steps, edge_docs, edge_rows, no_docs):
    found = language_model.score_documents(edge_docs).collect()
    assert len(found) == len(edge_rows) and all(math.isfinite(r.score) for r in found)
    assert language_model.score_documents(no_docs).count() == 0
    only_held = edge_docs.where("doc_id = 3")  # crc32("3") % 5 is not 1: train alone; then the reverse
    assert language_model.score_documents(only_held).count() == 2


def test_mixture_of_counts_and_attention_sums_to_one(spark, fewer_steps, monkeypatch):
    """Behind every prefix of every word, counts give one to all that may follow, and all of it the same weight."""
    models = []
    fit = language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(60)]
    language_model.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    (model,) = models
    scorer = language_model.Scorer(model)
    words = [[], *([w] for w in model.words)]
    before, starts, targets, seen, share, first, _ = scorer.streams(words)
    follow, levels = {}, {}
    for at in range(len(before)):
        prefix = tuple(before[starts[at] + 1 : at + 1].tolist())  # one word a text: all of it before this place
        follow.setdefault(prefix, {})[int(targets[at])] = (float(share[at]), bool(first[at]))
        levels.setdefault(prefix, set()).add(int(language_model.level(seen[at : at + 1])[0]))
    assert len(follow) > 60 and all(len(found) == 1 and found != {0} for found in levels.values())
    for prefix, found in follow.items():
        goes_on = sum(s for s, starts_word in found.values() if not starts_word)
        end = sum(s for s, starts_word in found.values() if starts_word)
        if prefix:  # the end of the text takes its part of what is left to all starts of words
            assert goes_on + end / model.end_share == pytest.approx(1, abs=1e-4) or not end
        else:
            assert goes_on + end == pytest.approx(1, abs=1e-4)
    assert model.mixing[0] == 0 and (model.mixing[1:] > 0).all() and (model.mixing < 1).all()


def fitted(spark, monkeypatch, texts):
    """The model behind the scores of the texts, all of them training texts."""
    models = []
    fit = language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    ids = [i for i in range(5 * len(texts) + 50) if zlib.crc32(str(i).encode()) % 5 != 1]
    language_model.score_documents(spark.createDataFrame(list(zip(ids, texts, strict=False)), "doc_id long, text string"))
    monkeypatch.setattr(language_model, "fit", fit)
    return models[0]


def test_attention_learns_from_texts_that_are_not_in_the_sample(spark, fewer_steps, monkeypatch):
    """Two corpora with the same counts and the same sample, but another order of words in the text that was not drawn, or
    beyond the part of it that is."""
    rng = random.Random(15)
    start = prose(rng, 40)
    words = prose(rng, 400).split()
    monkeypatch.setattr(language_model, "sample_texts", lambda training: [start.encode()])
    ratios, best = [], language_model.best_mixing
    monkeypatch.setattr(language_model, "best_mixing", lambda r: ratios.append(r) or best(r))
    one = fitted(spark, monkeypatch, [start, " ".join(words)])
    other = fitted(spark, monkeypatch, [start, " ".join(sorted(words))])
    assert (one.nodes == other.nodes).all() and (one.counts == other.counts).all()
    assert not np.allclose(one.tables.query, other.tables.query, atol=1e-3)
    ids = language_model.Subwords(one.path).encode([w.encode() for w in (start + " " + " ".join(words)).lower().split()])[1]
    assert all(r.sum() == len(ids) + 2 for r in ratios) and (ratios[0] != ratios[1]).any()


def test_mixing_is_the_same_for_words_that_are_held_and_joined(spark, fewer_steps, monkeypatch):
    rng = random.Random(16)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(60)] + [None, ""]
    found = []
    for bound in (5, 200_000):
        monkeypatch.setattr(language_model, "TOP_WORDS", bound)
        found.append(fitted(spark, monkeypatch, texts).mixing)
    assert np.allclose(*found, atol=0.021)  # a step of the grid


def test_long_texts_are_learned_from_in_pieces(spark, fewer_steps, monkeypatch):
    monkeypatch.setattr(language_model, "PASS_POSITIONS", 50)
    monkeypatch.setattr(language_model, "SCORED_BYTES", 300)
    rng = random.Random(17)
    docs = spark.createDataFrame([(i, prose(rng, 20 * i)) for i in range(12)], "doc_id long, text string")
    found = language_model.score_documents(docs).collect()
    assert len(found) == 12 and all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_mixing_weights_have_the_highest_likelihood():
    rng = np.random.default_rng(8)
    attended, share = rng.uniform(0.001, 0.5, 4000), rng.uniform(0, 0.5, 4000) * (rng.random(4000) < 0.9)
    seen = rng.integers(0, 40, 4000).astype("f8")
    ratios = language_model.count_ratios(attended, seen, share).reshape(language_model.WEIGHTS, -1)
    assert ratios.sum() == 4000
    weights, levels = language_model.best_mixing(ratios), language_model.level(seen)
    grid = np.linspace(0.02, 0.98, 49)
    assert weights[0] == 0
    for at in range(1, 7):
        mine = levels == at
        fits = [np.log((1 - w) * attended[mine] + w * share[mine]).sum() + np.log(w * (1 - w)) for w in grid]
        assert abs(grid[int(np.argmax(fits))] - weights[at]) < 0.021


def small_model(subwords=30, seed=2):
    rng = np.random.default_rng(seed)
    weights = attention.initial(subwords, seed)
    weights.near += rng.normal(size=attention.LENGTH).astype("f4") * 0.1
    return attention.tables(weights, np.log(np.full(subwords, 1 / subwords)))


def test_each_position_is_scored_once_and_sums_to_one():
    t, rng = small_model(), np.random.default_rng(1)
    lengths = [1, 5, 70, 23, 24, 25]
    ids = rng.integers(0, 30, sum(lengths))
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    every = np.array([attention.probabilities(t, ids, starts, np.full(len(ids), k)) for k in range(30)])
    assert every.shape[1] == len(ids) and np.allclose(every.sum(0), 1, atol=1e-4)
    # slices give the same, and a text does not see the text before it
    assert np.allclose(attention.probabilities(t, ids, starts, ids, slice_of=2), attention.probabilities(t, ids, starts, ids), rtol=1e-4)
    changed = ids.copy()
    changed[0] = (changed[0] + 1) % 30
    assert np.allclose(every[:, 1:], [attention.probabilities(t, changed, starts, np.full(len(ids), k))[1:] for k in range(30)], rtol=1e-5)


def test_no_position_sees_the_future():
    t, rng = small_model(), np.random.default_rng(3)
    ids, starts = rng.integers(0, 30, 60), np.zeros(60, np.int64)
    before = attention.probabilities(t, ids, starts, np.zeros(60, np.int64))
    ids[40:] = (ids[40:] + 7) % 30
    after = attention.probabilities(t, ids, starts, np.zeros(60, np.int64))
    assert np.allclose(before[:40], after[:40], rtol=1e-5) and not np.allclose(before[40:], after[40:], rtol=1e-3)


def test_an_update_does_not_depend_on_its_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    ids, targets = rng.integers(0, 40, 1000), rng.integers(0, 40, 1000)
    starts = np.repeat([0, 20, 531, 532], [20, 511, 1, 468])
    base, trained = np.log(np.full(40, 1 / 40)), []
    for piece in (1, 3, 1000):
        monkeypatch.setattr(attention, "PIECE", piece)
        trainer = attention.Trainer(base)
        trainer.update(ids, starts, targets, 0.003)
        t = attention.tables(attention.Trainer(base).weights, base)
        assert np.allclose(trainer.prob, attention.probabilities(t, ids, starts, targets), rtol=1e-4)
        trained.append(trainer.first)
    for other in trained[1:]:
        assert all(np.allclose(x, y, rtol=1e-3, atol=1e-9) for x, y in zip(trained[0], other, strict=True))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(7)
    ids, targets = rng.integers(0, 12, 50), rng.integers(0, 12, 50)
    starts = np.repeat([0, 20], [20, 30])
    base = np.log(np.full(12, 1 / 12))
    losses = []
    trainer = attention.Trainer(base)
    for _ in range(60):
        losses.append(trainer.update(ids, starts, targets, 0.05))
    assert losses[-1] > losses[0] + 0.5
    reached = attention.probabilities(attention.tables(trainer.weights, base), ids, starts, targets)
    assert np.log(reached).mean() > losses[0] + 0.5
