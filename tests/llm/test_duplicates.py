"""Near-duplicates, repeated passages and near vectors against brute force."""

import random

import numpy as np
import pytest
from conftest import prose

from cytogrid.llm import common, near_duplicates, passages, shingles, vectors
from cytogrid.llm.shingles import WordHashes, occurrences, shingle


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        what = rng.randrange(3)
        if what == 0:
            words[at] = prose(rng, 1)
        elif what == 1:
            words.insert(at, prose(rng, 1))
        else:
            del words[at]
    return " ".join(words)


def plain_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_alignment_is_the_longest():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(30))])
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(30))])
        runs = near_duplicates.align(a, b, 60)
        assert all((a[x : x + n] == b[y : y + n]).all() for x, y, n in runs)
        assert sum(n for *_, n in runs) == plain_lcs(a, b)
        assert all(x + n <= x2 and y + n <= y2 for (x, y, n), (x2, y2, _) in zip(runs, runs[1:], strict=False))
        least = len(a) + len(b) - 2 * plain_lcs(a, b)
        assert near_duplicates.align(a, b, least) is not None
        assert least == 0 or near_duplicates.align(a, b, least - 1) is None


def test_sketches_keep_order_and_occurrence():
    hashes = WordHashes()
    a, b = (prose(random.Random(i), 80).split() for i in (1, 2))
    of = lambda ws: near_duplicates.sketch(hashes.of([w.encode() for w in ws]))
    assert (of(a) == of(a)).all() and (of(a + b) == of(b + a)).mean() < 0.5
    assert (of(["x"] * 50) != of(["x"] * 60)).any()


def labels_of(pairs, names):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in names}


@pytest.fixture(scope="module")
def family_docs():
    """Chains of edits of one text, some far from its start, copies, and texts that share a passage alone."""
    rng = random.Random(21)
    base, shared = prose(rng, 150), prose(rng, 70)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    texts += [edited(rng, base, rng.randint(1, 6)) for _ in range(60)]
    for _ in range(4):
        chain = prose(rng, 120)
        for _ in range(6):
            texts.append(chain)
            chain = edited(rng, chain, 2)
    texts += [f"{prose(rng, 60)} {shared} {prose(rng, 60)}" for _ in range(40)]
    texts += rng.choices(texts, k=20) + ["short text", "short text", "short texts", "a b c d", "a b c d"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_near_duplicates_are_complete(spark, family_docs, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 16)  # several blocks in a bucket
    hashes = WordHashes()
    words = {i: hashes.of(t.encode().split()) for i, t in family_docs}
    sets = {i: set(near_duplicates.labelled_shingles(w).tolist()) for i, w in words.items()}
    text = dict(family_docs)
    links = [
        (a, b)
        for a in text for b in text
        if a < b and (text[a] == text[b] or near_duplicates.similarity(words[a], words[b]) >= 0.8)
    ]
    for a, b in links:  # aligned shingles never exceed common ones
        assert text[a] == text[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = labels_of(links, text)
    docs = spark.createDataFrame(family_docs, "doc_id long, text string").repartition(5)
    found = near_duplicates.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id for r in found if r.kept} == set(want.values())
    assert sum(len(set(x)) > 0 for x in [want.values()]) and len(set(want.values())) < len(want)


def test_near_duplicates_edge_cases(spark, edge_docs, edge_rows, no_docs):
    found = near_duplicates.near_duplicates(edge_docs).collect()
    assert len(found) == len(edge_rows)
    assert sorted(r.component_id for r in found if r.doc_id == 8) == [8, 8, 8]
    assert sum(r.kept for r in found) == len(edge_rows) - 2  # the repeated rows of 8
    kept = near_duplicates.representatives(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows) - 2
    assert near_duplicates.near_duplicates(no_docs).count() == 0
    nobody = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (7, "x y z")], "doc_id long, text string")
    rows = near_duplicates.near_duplicates(nobody).collect()
    assert {r.component_id for r in rows} == {7} and [r.doc_id for r in rows if r.kept] == [7]


def test_compact_windows_cover_all_windows():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    values[50:60] = values[120:130]
    for span in (2, 7, passages.SPAN):
        function, key, start, end = passages.compact_windows(values, span)
        assert len(start) < 4 * passages.FUNCTIONS * len(values) / span
        for f in range(passages.FUNCTIONS):
            covered = np.concatenate([np.arange(a, b + 1) for g, a, b in zip(function, start, end, strict=True) if g == f])
            assert covered.tolist() == list(range(len(values) - span + 1))
            hashed = passages.mix(values ^ passages.SEEDS[f, 0])
            for k, a, b in ((k, a, b) for g, k, a, b in zip(function, key, start, end, strict=True) if g == f):
                least = {hashed[i : i + span].min() for i in range(a, b + 1)}
                assert len(least) == 1 and passages.mix(np.array([least.pop()]) + passages.SEEDS[f, 0])[0] == k
    assert len(passages.compact_windows(values[: passages.SPAN - 1])[0]) == 0


@pytest.fixture(scope="module")
def passage_docs():
    rng = random.Random(31)
    common_one, near, short, line = prose(rng, 64), prose(rng, 80), prose(rng, 40), prose(rng, 8)
    texts = []
    for i in range(50):
        parts = [prose(rng, rng.randint(10, 150)), line if i % 3 else prose(rng, 8)]
        if i % 5 == 0:
            parts.insert(rng.randint(0, 2), common_one)
        if i % 7 == 0:
            parts.insert(rng.randint(0, 2), edited(rng, near, 1))
        if i % 3 == 0:
            parts.insert(rng.randint(0, 2), short)
        texts.append("\n".join(parts))
    texts += [f"{common_one} {prose(rng, 20)} {common_one}", "again " * 400, "other " + "again " * 300, texts[1], texts[2]]
    return list(enumerate(texts))


def test_passages_are_found_and_cut(spark, passage_docs):
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in passage_docs], "doc_id long, text string, n_chars int").repartition(4)
    words = {i: t.split() for i, t in passage_docs}
    windows = {}
    for i, ws in words.items():
        for k in range(len(ws) - passages.PASSAGE + 1):
            windows.setdefault(tuple(ws[k : k + passages.PASSAGE]), set()).add(i)
    repeated = set().union(*(x for x in windows.values() if len(x) > 1))
    found = passages.report(docs).collect()
    assert repeated <= {r.doc_id for r in found} | {r.other_doc_id for r in found}
    near = {i for i in range(50) if i % 7 == 0}
    assert {r.doc_id for r in found} | {r.other_doc_id for r in found} <= repeated | near
    assert near <= {r.doc_id for r in found}
    covered = {i: np.zeros(len(ws), bool) for i, ws in words.items()}
    for r in found:
        covered[r.doc_id][r.start_word : r.start_word + r.n_words] = True
    for i, ws in words.items():
        copies = {1, 2, 53, 54}  # whole texts, reported under one of them
        for k in range(len(ws) - passages.PASSAGE + 1):
            if i not in copies | near | {51, 52} and len(windows[tuple(ws[k : k + passages.PASSAGE])]) > 1:
                assert covered[i][k : k + passages.PASSAGE].all(), (i, k)
    cut = passages.cut_passages(docs)
    assert cut.columns == ["doc_id", "text", "n_chars"]
    left = cut.collect()
    assert all(r.n_chars == len(r.text) for r in left)
    after = {}
    for r in left:
        ws = r.text.split()
        for k in range(len(ws) - passages.PASSAGE + 1):
            after.setdefault(tuple(ws[k : k + passages.PASSAGE]), set()).add(r.doc_id)
    assert all(len(x) == 1 or x <= near | {51, 52} for x in after.values())
    gone = {w for w, x in windows.items() if len(x) > 1} - set(after)
    assert not {w for w in gone if " ".join(w) in dict(passage_docs)[0]} - set(windows)
    untouched = set(words) - repeated - near
    assert untouched and all(r.text == dict(passage_docs)[r.doc_id] for r in left if r.doc_id in untouched)


def test_no_exact_passage_hides_behind_texts_with_a_part_of_it(spark):
    rng = random.Random(43)
    texts = []
    for _ in range(25):
        passage = prose(rng, 52)
        words = passage.split()
        texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(2)]
        for _ in range(40):  # each has a part only, so signatures have different heads
            at = rng.randrange(22)
            texts.append(f"{prose(rng, 20)} {' '.join(words[at : at + 31])} {prose(rng, 20)}")
    base = prose(rng, 120)
    texts += [edited(rng, base, 5) for _ in range(80)]  # near copies
    rng.shuffle(texts)
    windows = {}
    for i, t in enumerate(texts):
        ws = t.split()
        for k in range(len(ws) - passages.PASSAGE + 1):
            windows.setdefault(tuple(ws[k : k + passages.PASSAGE]), set()).add((i, k))
    covered = {i: np.zeros(len(t.split()), bool) for i, t in enumerate(texts)}
    for r in passages.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        covered[r.doc_id][r.start_word : r.start_word + r.n_words] = True
    lost = {i for places in windows.values() if len(places) > 1 for i, k in places if not covered[i][k : k + passages.PASSAGE].all()}
    assert not lost


def test_passages_of_lines_that_stand_elsewhere_before():
    rng, hashes = random.Random(41), WordHashes()
    one, two = prose(rng, 25), prose(rng, 25)
    seam = " ".join(one.split()[-6:] + two.split()[:6])  # with it, every shingle of the passage stands elsewhere before
    a = f"{one} {prose(rng, 30)} {two} {seam} {prose(rng, 18)} {one} {two} {prose(rng, 10)}"
    b = f"{prose(rng, 12)} {one} {two} {prose(rng, 12)}"
    of = lambda text: passages.Prepared.of(hashes.of(text.encode().split()))
    for x, y, starts in ((a, b, (110, 12)), (b, a, (12, 110))):
        assert (starts[0], 50, starts[1], 50) in passages.shared_spans(of(x), of(y))
    many = " ".join(f"{one} {prose(rng, 9)} {two} {prose(rng, rng.randint(9, 30))}" for _ in range(30))
    long = f"{many} {one} {two} {prose(rng, 9)}"  # diagonals lie so close that they count together
    start = len(many.split())
    found = passages.shared_spans(of(long), of(f"{many[::-1]} {b}"))
    assert any(x <= start and x + n >= start + 50 for x, n, _, _ in found)


def test_word_sums_tell_words_apart(monkeypatch):
    rng = random.Random(42)
    for size in (shingles.SPAN_BYTES, 16):  # in one go, and in portions
        monkeypatch.setattr(shingles, "SPAN_BYTES", size)
        long = b"x" * 300
        words = [bytes(rng.choices(b"ab\xc3", k=rng.randint(1, 4))) for _ in range(500)] + [long, long + b"y", long]
        text = b" " + b"".join(w + rng.choice([b" ", b"\n\t", b"\x0b\x0c\r"]) for w in words)
        sums = shingles.word_sums(text).tolist()
        assert [words.index(w) for w in words] == [sums.index(x) for x in sums]
        assert shingles.word_sums(b"\x1ca " + words[0])[1] == sums[0]  # wherever a word stands
        assert not len(shingles.word_sums(b"")) and not len(shingles.word_sums(b" \n"))


def test_texts_without_enough_shared_shingles_are_not_laid_side_by_side(monkeypatch):
    rng = random.Random(43)
    line, part = prose(rng, 20), prose(rng, 55)
    of = lambda text: passages.Prepared.of(shingles.word_sums(text.encode()))
    a, b = (of(" ".join(f"{prose(rng, 60)} {line}" for _ in range(4))) for _ in range(2))
    both = [of(f"{prose(rng, 30)} {part} {prose(rng, 30)}") for _ in range(2)]
    assert (30, 55, 30, 55) in passages.shared_spans(*both)
    monkeypatch.setattr(passages, "diagonals", None)
    assert passages.shared_spans(a, b) == []


def test_texts_travel_packed():
    text = prose(random.Random(47), 4000).encode()
    assert len(passages.pack(text)) < 0.7 * len(text)
    for x in (text, b"", b" ", "\u00e4\n\u00e9 ".encode() * 300, b"\xff\x00"):
        assert passages.unpack(passages.pack(x)) == x


def test_cut_spans_merge():
    assert passages.cut_spans(b" a b c d e ", [(1, 2), (2, 2), (9, 1)]) == b" a e "
    assert passages.cut_spans(b"a b", [(0, 2)]) == b""


def test_passages_edge_cases(edge_docs, edge_rows, no_docs):
    assert passages.report(edge_docs).count() == 0  # rows that repeat id and text are one document
    cut = passages.cut_passages(edge_docs)
    assert cut.columns == edge_docs.columns and cut.count() == len(edge_rows)
    assert passages.report(no_docs).count() == 0 and passages.cut_passages(no_docs).count() == 0


@pytest.mark.parametrize("dimension", [16, 64])
def test_vectors(spark, dimension):
    rng = np.random.default_rng(dimension)
    x = rng.normal(size=(400, dimension))
    x[100:160] = x[99] + rng.normal(size=(60, dimension)) * 0.25
    for i in range(200, 260):  # chains of links
        x[i] = x[i - 1] + rng.normal(size=dimension) * 0.35
    x[300:320] = x[299]
    x[320:330] = x[299] * 3
    vectors_of = [[float(v) for v in row] for row in x] + [None, [], [0.0] * dimension, [float("nan")] * dimension, [None] * dimension, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, "n", 1) for i, v in enumerate(vectors_of)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, links int").repartition(4)
    found = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= vectors.COSINE
    np.fill_diagonal(linked, False)
    assert abs(unit @ unit.T - vectors.COSINE).min() > 1e-9
    truth = labels_of([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True) if a < b], range(400))
    counted = np.array([found[i].n_links for i in range(400)])
    assert counted.sum() >= 0.995 * linked.sum() and (counted <= linked.sum(1)).all()
    assert np.mean([found[i].component_id == truth[i] for i in range(400)]) > 0.99
    for i in range(400, 405):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[405].n_links, found[406].component_id) == (1, 405)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert vectors.near_vectors(table.where("false")).count() == 0


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 64))
    b = a + rng.normal(size=(300, 64)) * 0.5
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    turns = 6
    signs, factors = vectors.encode(a, turns)
    turned = np.einsum("rij,nj->nri", vectors.rotations(64, turns), b)
    estimate = ((signs * 2.0 - 1) / 8 * turned).sum(2) / factors
    exact = (a * b).sum(1)
    assert abs((estimate - exact[:, None]).mean()) < 0.01
    error = np.sqrt(((1 - factors**2) / (factors**2 * 63)).sum(1)) / turns
    assert (abs(estimate.mean(1) - exact) <= vectors.SIGMAS * error).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(5, 5)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    truth = labels_of(edges, {x for e in edges for x in e})
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {n: truth[n] for n in linked}


def test_occurrences_and_shingles():
    assert occurrences(np.array([3, 1, 3, 3, 1])).tolist() == [0, 0, 1, 2, 1]
    words = np.arange(1, 8, dtype=np.uint64)
    assert len(shingle(words)) == 3 and len(shingle(words[:4])) == 1 and len(shingle(words[:0])) == 0
    assert shingle(words[1:6])[0] == shingle(words)[1]
