"""Spelling variants against the plain rule, with one tree, many leaves and dealt blocks."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cytogrid.llm import letter_tree, spelling

LETTERS = "abcdeéßÿ×"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
                run += chr(ord(c) + 32)
            elif "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, n, len(others), words.get(best))
    found = {}
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found[w] = (form, root, n, n_near, form_n if form else None)
    return found


def words(rng, n):
    base = ["".join(rng.choices(LETTERS, k=rng.randint(6, 9))) for _ in range(n)]
    texts = []
    for w in base:
        texts += [w] * rng.choice([5, 30, 200])
        for _ in range(4):
            at = rng.randrange(len(w))
            texts += [w[:at] + rng.choice(["", rng.choice(LETTERS), w[at] + "b"]) + w[at + 1 :]] * rng.choice([4, 5, 7])
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("leaf, askers", [(150_000, 4), (900, 1), (450, 0.25)])
def test_matches_plain_rule(spark, edge_rows, monkeypatch, leaf, askers):
    rng = random.Random(2)
    all_words = words(rng, 60)
    rows = [(i, " ".join(all_words[i::40])) for i in range(40)] + [*edge_rows, (7, "Straße STRASSE-straße " * 9)]
    rows += [(90 + i, "abcabcabc " * 40 + "abcabcabd " * 6 + "abcabcaed " * (i % 2)) for i in range(10)]  # forms of forms
    docs = spark.createDataFrame([(i, t, "w", 1, 1) for i, t in rows], "doc_id long, text string, word string, n int, leaf int")
    monkeypatch.setattr(spelling, "LEAF_LETTERS", leaf)
    monkeypatch.setattr(spelling, "ASKERS", askers)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs).collect()}
    assert found == plain(rows)
    assert any(f[0] for f in found.values()) and any(f[1] != (f[0] or w) for w, f in found.items())


def test_empty_table(no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0


def test_a_leaf_of_anagrams_is_dealt(spark, monkeypatch):
    rng = random.Random(4)
    pool = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(400)})
    pool += ["x" + w[1:] for w in pool[::3]]
    monkeypatch.setattr(spelling, "LEAF_LETTERS", 8 * 64)
    table = spark.createDataFrame([(w, 5) for w in sorted(set(pool))], "word string, n long")
    found = {r["word"]: r["n_near"] for r in spelling.near_words(table).collect()}
    want = {w: sum(near(w, x) for x in set(pool)) for w in set(pool)}
    assert found == {w: n for w, n in want.items() if n}


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    held, asked = (rng.poisson(0.7, (n, letter_tree.DIMS)).astype(np.int16)[:, :] for n in (500, 300))
    held[:, 6:] = asked[:, 6:] = 0
    apart = np.abs(held[None] - asked[:, None]).sum(axis=2)
    for leaf in (1, 40, 1000):
        tree = letter_tree.LetterTree(held, leaf)
        assert sorted(np.concatenate(tree.leaves)) == list(range(500))
        for radius in (0, 1, 2):
            pairs = {(a, b) for x, y in tree.pairs(asked, radius) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
            assert pairs == set(zip(*(v.tolist() for v in np.nonzero(apart <= radius)), strict=True))
