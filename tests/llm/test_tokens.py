"""Encoding, counting and records against the libraries."""

import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rentloom.llm.batches import Memo
from rentloom.llm.piece_codec import Encoder, decode_pieces, encode_pieces, round_trip
from rentloom.llm.pieces import Normalizer, PieceModel
from rentloom.llm.token_counts import MergeCounter, token_counts
from rentloom.llm.token_records import TokenBytes, frame, token_records, unframe

MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
SPEC = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
ALPHABET = ["a", "b", "é", " ", "  ", "\n", " \n", "日", "'s", "'re", "1", "２", "<|endoftext|>", "\t", "!", "▁", "\x85", "😀", "<s>", "the", "ing", "ﬁ", "́"]


def noise(n):
    rng = random.Random(3)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_and_spans_equal_the_library():
    library, encoder, counter = sentencepiece.SentencePieceProcessor(model_proto=MODEL), Encoder(MODEL), MergeCounter(MODEL)
    for text in noise(3000):
        ids, starts, ends = encoder(text.encode())
        assert ids == library.encode(text)
        assert counter(text.encode()) == len(ids)
        proto = library.encode(text, return_type="proto")
        for piece, start, end in zip(proto.pieces, starts, ends, strict=True):
            if not encoder.is_byte[piece.id]:
                assert text.encode()[start:end].decode() == piece.surface


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf"])
def test_character_map_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    normalizer = Normalizer(PieceModel.parse(library.serialized_model_proto()))
    for text in [*noise(2000), "Å ｶﾞ ㌔ ½", "x́  y "]:
        normal, source = normalizer.aligned(text.encode())
        assert normal.decode().replace(" ", "▁") == library.normalize(text).replace(" ", "▁")
        if source is not None and len(normal):
            assert (np.diff(source) >= 0).all() and len(source) == len(normal) + 1 and source[-1] <= len(text.encode())


def test_round_trip_of_odd_texts(docs_of, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.spans_tile) for r in round_trip(docs_of(odd_texts), MODEL).collect())
    ids = [(i or -1, library.encode(t or "")) for i, t in odd_texts]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x)), True) for i, x in ids)


def test_encode_then_decode(docs_of, odd_texts):
    rows = decode_pieces(encode_pieces(docs_of(odd_texts), MODEL), MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert sorted(r.decoded for r in rows) == sorted(library.decode(library.encode(t or "")) for _, t in odd_texts)
    assert encode_pieces(docs_of([]), MODEL).collect() == []


def test_counts(docs_of, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs_of(odd_texts), MODEL, 100).collect())
    want = [(i or -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t in odd_texts]
    assert got == sorted((*w, w[2] > 100) for w in want)


def test_record_bytes_equal_the_library():
    library, packed = Tokenizer.from_str(SPEC), TokenBytes(SPEC)
    for text in noise(4000):
        assert np.frombuffer(packed(text), packed.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_records(docs_of, odd_texts):
    library = Tokenizer.from_str(SPEC)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records(docs_of(odd_texts), SPEC, 2).collect())
    rows = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, want = 0, []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, key, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    assert token_records(docs_of([]), SPEC, 2).collect() == []


def test_a_broken_record_is_noticed():
    record = frame(b"payload")
    assert unframe(record) == b"payload"
    for at in range(len(record)):
        with pytest.raises(ValueError):
            unframe(record[:at] + bytes([record[at] ^ 1]) + record[at + 1:])


def test_memo_keeps_what_is_used_again():
    made = []
    memo = Memo(lambda x: made.append(x) or x * 2, limit=3)
    assert [memo[x] for x in (1, 2, 3, 1, 4, 1, 5)] == [2, 4, 6, 2, 8, 2, 10]
    assert made == [1, 2, 3, 4, 5] and len(memo) <= 3
