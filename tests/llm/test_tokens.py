"""Token counts, packing and sentence pieces against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import prose
from sentencepiece import sentencepiece_model_pb2 as model_pb2
from tokenizers import Tokenizer

from cytogrid.llm import packing, sentence_pieces, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(edge_docs, edge_rows, library):
    found = token_counts.token_counts(edge_docs, limit=150).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 150) for i, t in edge_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want


def test_random_characters_count_like_the_library(library):
    rng = random.Random(3)
    counter = token_counts.Counter(WORD_BPE, token_counts.prove_whole(library), token_counts.prove_plain(library))
    pool = [chr(c) for c in [*range(32, 0x250), 0x2019, 0x3B1, 0x416, 0x4E00, 0x1F600, 0x301, 0x200B, 0x2028]]
    texts = ["".join(rng.choices(pool, k=60)) for _ in range(300)] + ["it's we'll I'd 'S 'T", "don''t ''s"]
    assert counter.count([t.encode() for t in texts]) == [len(ids_of(library, t)) for t in texts]


def test_proven_strings_are_one_token(library):
    whole = token_counts.prove_whole(library)
    assert "the" in whole and len(whole) > 10_000
    some = sorted(whole)[::500]
    assert all(len(ids_of(library, t)) == 1 for t in some)


def test_pieces_hold_each_id_once(edge_docs, edge_rows, library):
    rows = packing.pack(edge_docs, longest=256).collect()
    want = {}
    for i, t in edge_rows:
        want.setdefault(i, []).append([*ids_of(library, t), 1])
    by_id = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.length & (r.length - 1) == 0 and r.length <= 256
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.offset == 0 and 2**r.bucket == r.length
        docs = by_id.setdefault(r.doc_id, [])
        if r.start == 0:
            docs.append([])
        assert len(docs[-1]) == r.start
        docs[-1] += ids.tolist()
    assert {i: sorted(x) for i, x in by_id.items()} == {i: sorted(x) for i, x in want.items()}
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_written_buckets(edge_docs, tmp_path):
    packing.write_buckets(packing.pack(edge_docs), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} >= {"bucket=0", "bucket=11"}


def test_empty_tables(no_docs):
    assert token_counts.token_counts(no_docs).count() == 0
    assert packing.pack(no_docs).count() == 0
    assert sentence_pieces.encode(no_docs).count() == 0


def test_pieces_must_be_a_power_of_two(no_docs):
    with pytest.raises(ValueError):
        packing.pack(no_docs, longest=1000)


def test_sentence_pieces_equal_the_library(edge_docs, edge_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentence_pieces.encode(edge_docs)
    found = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in encoded.collect())
    want = sorted((i is None, i or 0, np.array(library.encode(t or ""), "<u4").tobytes()) for i, t in edge_rows)
    assert found == want
    assert encoded.where("NOT parity").count() == 0
    assert [r.doc_id for r in encoded.where("NOT round_trip").collect()] == [10]  # the text with the marker itself
    back = {(r.doc_id, r.text) for r in sentence_pieces.decode(encoded).collect()}
    assert back == {(i, (t or "").replace("▁", " ") if i != 10 else " mark  ") for i, t in edge_rows}


def test_random_texts_have_parity():
    codec = sentence_pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(32, 127), 0xE9, 0xDF, 0x416, 0x4E00, 0x1F600, 10]] + [" "] * 40
    texts = ["".join(rng.choices(pool, k=200)) for _ in range(100)] + ["aaaaaaaaa", "    a    ", "\n\n", prose(rng, 50)]
    for (ids, equal), text in zip(codec.encode([t.encode() for t in texts]), texts, strict=True):
        assert equal and codec.decode(ids).decode() == text
        assert np.frombuffer(ids, "<u4").tolist() == codec.library.encode(text)


@pytest.mark.parametrize("extra", [False, True])
def test_unigram_model(tmp_path, extra):
    proto = model_pb2.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = True, extra
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁cat", "▁ca", "t", "c", "a", "s", "at", "▁sat", "e", "h"]
    for piece, score, kind in [*pieces, *((w, -1.0 - i / 3, 1) for i, w in enumerate(words))]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "u.model"
    path.write_bytes(proto.SerializeToString())
    codec = sentence_pieces.Codec(str(path))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the cat sat", "cats  at the hat", " x ", "", "tattat é"]
    for (ids, equal), text in zip(codec.encode([t.encode() for t in texts]), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
        assert equal
