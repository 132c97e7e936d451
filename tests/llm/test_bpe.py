"""Byte-level BPE beside tiktoken, and the way back."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pitpanel.llm import bpe

VOCABULARY = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "hello world", "Hello  world\n\n\n  next\tline 12345 don't we'll", "naïve café — ünïcödé 日本語テキスト 🙂🙂🙂",
         "a" * 5000, "ab" * 700, "  " * 3000, "!?" * 900, "<|endoftext|> not special", "\u0000\u0001 x", "hello world",
         "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(3000)), "x y z " * 400_000]


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coded(spark):
    docs = spark.createDataFrame([(i, t, "junk", 7) for i, t in enumerate(TEXTS)], "doc_id int, text string, ids string, n_tokens int")
    tokens = bpe.encode(docs, VOCABULARY, P.PATTERN, ["doc_id"])
    return bpe.decode(tokens, VOCABULARY, ["doc_id"], ["n_tokens"]).join(tokens.select("doc_id", "ids"), "doc_id").collect()


def test_ids_equal_the_public_library(coded, reference):
    assert len(coded) == len(TEXTS)
    for row in coded:
        want = reference.encode_ordinary(TEXTS[row.doc_id] or "")
        assert np.frombuffer(row.ids, "<u4").tolist() == want, row.doc_id
        assert row.n_tokens == len(want)


def test_decoding_gives_the_text_back(coded):
    for row in coded:
        assert row.decoded == (TEXTS[row.doc_id] or "").encode()


def test_random_pieces_in_one_matrix_and_in_the_heap(reference):
    with open(VOCABULARY, "rb") as f:
        merges = bpe.Merges(f.read())
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcdeint \xc3\xa9\xff") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    got = merges.encode_pieces(pieces)
    for piece, ids in zip(pieces, got):
        want = reference._core_bpe.encode_single_piece(piece)
        assert np.frombuffer(ids, "<u4").tolist() == want
        if piece not in merges.ranks:
            assert merges._by_heap(piece) == ids


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.encode(docs, VOCABULARY, P.PATTERN, ["doc_id"]).collect() == []
    assert bpe.encode(docs, VOCABULARY, P.PATTERN, []).collect() == []
