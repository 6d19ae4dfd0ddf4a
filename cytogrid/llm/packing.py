"""Sequences of binary length, each from a single document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import binary_text, forget, map_batches, new_words
from cytogrid.llm.token_counts import PreTokens, load, prove_plain

_workers: dict[str, WordIds] = {}


class WordIds:
    """Ids of words between blanks, as little-endian unsigned 32-bit numbers.

    No pre-token and no special string of the vocabulary holds a blank, so the ids of a text
    are those of its words in turn; the library merges each distinct pre-token.
    """

    def __init__(self, path: str, plain: str):
        self.pre_tokens = PreTokens(path, plain)
        self.cache: dict[bytes, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        split = {w: self.pre_tokens.split(w) for w in words}
        rest = sorted({p for ps in split.values() if ps for p in ps if p not in self.merged})
        self.merged |= zip(rest, self.pre_tokens.merge(rest), strict=True)
        odd = [w for w, ps in split.items() if ps is None]
        self.cache |= zip(odd, self.pre_tokens.library(odd), strict=True)
        for word, ps in split.items():
            if ps is not None:
                self.cache[word] = self.merged[ps[0]] if len(ps) == 1 else b"".join(map(self.merged.__getitem__, ps))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        forget(self.cache)
        forget(self.merged)
        split = [t.split() for t in texts]
        self.learn(new_words(split, self.cache))
        for words in split:
            yield b"".join(map(self.cache.__getitem__, words))


def binary_pieces(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length): as many longest pieces as fit, then one for each bit of what is left.

    >>> binary_pieces(4096 + 5, 2048)
    [(0, 2048), (2048, 2048), (4096, 4), (4100, 1)]
    """
    pieces, start = [], 0
    while start < tokens:
        length = min(longest, 1 << ((tokens - start).bit_length() - 1))
        pieces.append((start, length))
        start += length
    return pieces


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = 2048,
    end_id: int = 1,
    tokenizer_path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    A document's ids, with ``end_id`` behind them, are cut by the power-of-two decomposition,
    so every piece is a sequence of its own, without padding and without a second document.
    ``bucket`` is the binary logarithm of the length: batches of equal length come from one bucket
    (``write_buckets``). Sequences are numbered by task and place in it, which needs no shuffle;
    a task's rows are committed together, so numbers stay distinct when executors are lost.
    A null or empty text is the end id alone. Repeated rows give their pieces each. Other columns
    are ignored. A text is held whole, its ids as 4 bytes each.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    plain = prove_plain(load(path))
    end = end_id.to_bytes(4, "little")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = WordIds(path, plain)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, ids in zip(batch.column(0).to_pylist(), _workers[path].encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for start, length in binary_pieces(len(ids) // 4, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(piece), len(ids) // 4, piece)
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), binary_text(text_column).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_batches(rows, work, schema).select(
        F.col("id").alias(id_column),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.floor(F.log2("length") + F.lit(0.5)).cast("int").alias("bucket"),
        *["ids"] * with_ids,
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences in one folder per length, so that a reader fills batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)
