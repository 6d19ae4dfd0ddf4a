"""Token counts with a shortcut for pre-tokens that are one token by proof."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import binary_text, forget, map_batches, new_words

#: Code points whose class and normal form are compared with the library; others go to it.
PROVEN_BELOW = 0x250
_workers: dict[str, Counter] = {}


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def unicode_of_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole(tokenizer) -> frozenset[str]:
    """Strings of the vocabulary that, encoded alone, give exactly their own one id."""
    back = unicode_of_bytes()
    candidates = {}
    for piece, token_id in tokenizer.get_vocab(with_added_tokens=False).items():
        if piece.endswith("</w>"):
            try:
                candidates[bytes(back[c] for c in piece[:-4]).decode()] = token_id
            except (KeyError, UnicodeDecodeError):  # not a string that a text can hold
                continue
    texts = sorted(candidates)
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded, strict=True) if e.ids == [candidates[t]])


SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+"


def prove_plain(tokenizer) -> str:
    """Characters that Python normalises and splits as the library does, alone and between others."""
    split = re.compile(SPLIT)
    agreed = []
    for code in range(0x21, PROVEN_BELOW):
        c = chr(code)
        probes = (c, f"a{c}a", f"1{c}1", f"!{c}!", f"a1{c}{c}b", f"{c}'s{c}")
        if all(
            split.findall(unicodedata.normalize("NFC", p).lower())
            == [p[s:e] for p in [tokenizer.normalizer.normalize_str(p)] for _, (s, e) in tokenizer.pre_tokenizer.pre_tokenize_str(p)]
            for p in probes
        ):
            agreed.append(c)
    return "".join(agreed)


class PreTokens:
    """Splits words as the library does, where that is proven, and merges pre-tokens by the library.

    Pre-tokens go to it many at a time with blanks between them; each one's ids end with
    the only piece that carries the mark of a word's end.
    """

    def __init__(self, path: str, plain: str):
        self.tokenizer = load(path)
        self.plain = re.compile(f"[{re.escape(plain)}]+")
        self.pattern = re.compile(SPLIT)
        self.letters = set(string.ascii_letters) <= set(plain)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def split(self, word: bytes) -> list[str] | None:
        """None: a special string, or letters without proof; the library takes the whole word."""
        if word.isalpha() and self.letters:  # ASCII letters only
            return [word.lower().decode()]
        text = word.decode()
        if "<|" in text or not self.plain.fullmatch(text):
            return None
        return self.pattern.findall(unicodedata.normalize("NFC", text).lower())

    def merge(self, parts: list[str]) -> list[bytes]:
        """The ids of each pre-token, 4 bytes each, little-endian."""
        out: list[bytes] = []
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise RuntimeError("a pre-token did not end with its one last piece")
            raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def library(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]


class Counter:
    """Token counts of words between blanks; a word's count does not depend on its neighbours."""

    def __init__(self, path: str, whole: frozenset[str], plain: str):
        self.pre_tokens, self.whole = PreTokens(path, plain), whole
        self.cache: dict[bytes, int] = {}
        self.merged: dict[str, int] = {}

    def learn(self, words: list[bytes]) -> None:
        split = {w: self.pre_tokens.split(w) for w in words}
        rest = sorted({p for ps in split.values() if ps for p in ps if p not in self.whole and p not in self.merged})
        self.merged |= zip(rest, (len(x) // 4 for x in self.pre_tokens.merge(rest)), strict=True)
        odd = [w for w, ps in split.items() if ps is None]
        self.cache |= zip(odd, (len(x) // 4 for x in self.pre_tokens.library(odd)), strict=True)
        for word, ps in split.items():
            if ps is not None:
                self.cache[word] = sum(1 if p in self.whole else self.merged[p] for p in ps)

    def count(self, texts: list[bytes]) -> list[int]:
        forget(self.cache)
        forget(self.merged)
        split = [t.split() for t in texts]
        self.learn(new_words(split, self.cache))
        return [sum(map(self.cache.__getitem__, words)) for words in split]


def token_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048, tokenizer_path: str | None = None
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the library counts.

    The driver proves once which vocabulary strings encode alone as one token, and for
    which characters Python splits as the library does; both are bounded by the vocabulary
    and broadcast. Tasks count proven pre-tokens directly and merge the rest. A null
    text counts as empty; repeated rows are counted each; other columns are ignored. Long
    texts are counted whole, as no token crosses a blank.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    tokenizer = load(path)
    proof = docs.sparkSession.sparkContext.broadcast((prove_whole(tokenizer), prove_plain(tokenizer)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = Counter(path, *proof.value)
        counter = _workers[path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), binary_text(text_column).alias("text"))
    counted = map_batches(rows, work, "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
