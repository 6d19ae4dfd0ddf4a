import random

import pytest

SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, repeated rows and ids, odd letters and blanks."""
    rng = random.Random(5)
    texts = [
        None, "", " \n\t ", "one", "It's  two, THREE!\n\n<|endoftext|> <|startoftext|>x", prose(rng, 30_000),
        "naïve café ÀÉÎ ﬁ ǅ ß İ ¼ ² Ω 漢字 🙂 e\u0301", "a\u00a0b\u2003c\x1cd\x85e", prose(rng, 200), "x" * 5000, "▁mark ▁", "  lead  and trail ",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (8, texts[8]), (8, texts[8]), (None, "no id"), (None, None), (3, "same id, other text")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names clash with those that operators use inside."""
    rows = [(i, t, 1, "a", 2.0, True, "z") for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, key string, n_tokens double, kept boolean, id string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
