"""SentencePiece models run by the tokenizers library."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.common import binary_text, forget, map_batches, new_words

MARK = "▁"  # stands for a blank inside pieces
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the model format
UNIGRAM, BPE = 1, 2
_workers: dict[tuple, Codec] = {}


def parse(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


def rebuild(proto):
    """A ``tokenizers.Tokenizer`` for text that ``normalise`` has prepared."""
    from tokenizers import Tokenizer, models

    pieces = proto.pieces
    vocab = {p.piece: i for i, p in enumerate(pieces)}
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    kind, fallback = proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback
    if kind == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in pieces], unknown, fallback)
    elif kind == BPE:
        usable = {p.piece: (p.score, i) for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
        merges = [
            (-score, i, cut, piece[:cut], piece[cut:])
            for piece, (score, i) in usable.items()
            for cut in range(1, len(piece))
            if piece[:cut] in usable and piece[cut:] in usable
        ]
        merges = [(left, right) for _, _, _, left, right in sorted(merges)]
        model = models.BPE(vocab, merges, unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"no such kind of model here: {kind}")
    return Tokenizer(model)


def normaliser(proto):
    """A function from text to text with blanks marked, or None if it only marks blanks."""
    spec = proto.normalizer_spec
    if not spec.precompiled_charsmap and not spec.remove_extra_whitespaces:
        return None
    from tokenizers import normalizers

    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    chars = normalizers.Sequence(steps)
    extra = re.compile(" +") if spec.remove_extra_whitespaces else None

    def normalise(text: str) -> str:
        text = chars.normalize_str(text)
        return extra.sub(" ", text).strip(" ") if extra else text

    return normalise


class Codec:
    """Encodes and decodes with a rebuilt model.

    A chunk is a run of blanks with the characters up to the next blank. If no piece
    holds a marker behind another character (checked), merges never cross chunks, and each
    distinct chunk is encoded once; otherwise the whole text is one chunk.
    """

    def __init__(self, path: str, verify: bool = True, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        proto = parse(path)
        self.tokenizer, self.normalise = rebuild(proto), normaliser(proto)
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.split = not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (NORMAL, USER))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if verify else None
        self.verify_whole = self.normalise is not None or not self.dummy or not self.split
        self.cache: dict[bytes, bytes] = {}
        self.wrong: set[bytes] = set()
        self.chunk = re.compile(rb" *[^ ]+| +\Z")
        self.bytes_of = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
            else b"" if p.type == CONTROL
            else " ⁇ ".encode() if p.type == UNKNOWN
            else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]

    def chunks(self, text: bytes) -> list[bytes]:
        """Keys of the chunks: with a dummy prefix, one leading blank of each is left out."""
        if self.normalise:
            text = self.normalise(text.decode()).encode()
        if not text:
            return []
        if b"\xe2\x96\x81" in text:
            text = text.replace(b"\xe2\x96\x81", b" ")
        if not self.split:
            return [b" " + text if self.dummy else text]
        if not self.dummy:
            return self.chunk.findall(text)
        if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.split(b" ")
        return [c[1:] for c in self.chunk.findall(b" " + text)]

    def learn(self, keys: list[bytes]) -> None:
        lead = " " if self.dummy and self.split else ""
        encoded = self.tokenizer.encode_batch_fast(
            [(lead + k.decode()).replace(" ", MARK) for k in keys], add_special_tokens=False
        )
        ids = [e.ids for e in encoded]
        if self.library and not self.verify_whole:
            expected = self.library.encode([k.decode() for k in keys], num_threads=1)
            expected = [want if key else [self.library.piece_to_id(MARK)] for key, want in zip(keys, expected, strict=True)]
            for i, (key, want) in enumerate(zip(keys, expected, strict=True)):
                if ids[i] != want:
                    self.wrong.add(key)
                    ids[i] = want
        for key, got in zip(keys, ids, strict=True):
            self.cache[key] = b"".join(i.to_bytes(4, "little") for i in got)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bool]]:
        """(ids as 4 bytes each, whether all of them came out as the original library gives them)."""
        if len(self.cache) > 400_000:
            self.wrong.clear()
        forget(self.cache)
        split = [self.chunks(t) for t in texts]
        self.learn(new_words(split, self.cache))
        for text, keys in zip(texts, split, strict=True):
            ids = b"".join(map(self.cache.__getitem__, keys))
            equal = not self.wrong or self.wrong.isdisjoint(keys)
            if self.library and self.verify_whole:
                want = b"".join(i.to_bytes(4, "little") for i in self.library.encode(text.decode()))
                equal, ids = ids == want, want
            yield ids, equal

    def decode(self, ids: bytes) -> bytes:
        text = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        return text[1:] if self.dummy and text[:1] == b" " else text


def encode(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    model_path: str | None = None,
    verify: bool = True,
    threads: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, ids_crc32, round_trip, parity, and the ids (4 bytes each).

    ``parity``: every distinct chunk of the text was also encoded by the original library with
    the same ids (where they differ, the library's ids are returned). ``round_trip``: decoding
    gives the text's bytes. ``threads`` are those of a batch inside a task. Null and empty texts have no
    ids and come back; a text with the marker itself does not. Rows are independent, repeated rows
    are encoded each, other columns are ignored.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    names = ["id", "n_bytes", "n_tokens", "ids_crc32", "round_trip", "parity"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, verify, threads) not in _workers:
            _workers[path, verify, threads] = Codec(path, verify, threads)
        codec = _workers[path, verify, threads]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [
                (doc_id, len(text), len(ids) // 4, zlib.crc32(ids), codec.decode(ids) == text, equal, ids)
                for doc_id, text, (ids, equal) in zip(batch.column(0).to_pylist(), texts, codec.encode(texts), strict=True)
            ]
            columns = list(zip(*rows, strict=True))[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), binary_text(text_column).alias("text"))
    schema = "id long, n_bytes long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"
    return map_batches(rows, work, schema + ", ids binary" * with_ids).withColumnRenamed("id", id_column)


def decode(
    encoded: DataFrame, ids_column: str = "ids", text_column: str = "text", model_path: str | None = None
) -> DataFrame:
    """Adds the text of each row's ids (4 bytes each); null ids give an empty text.

    The other columns stay; one named as ``text_column`` is replaced.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def texts(ids):
        key = (path, False, 1)
        if key not in _workers:
            _workers[key] = Codec(*key)
        return ids.map(lambda x: _workers[key].decode(x or b"").decode("utf-8", "replace"))

    return encoded.withColumn(text_column, texts(F.coalesce(F.col(ids_column), F.lit(b""))))
