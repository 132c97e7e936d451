"""Cross-tokenizer alignment beside a plain double loop over tokens: given texts, odd texts, both ways to read counts back."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pitpanel.llm import crosstok
from pitpanel.llm.registered import QUERIES
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

A, B, WIDTH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), 32000
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def tokens(text):
        own = a.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(letters[c] for c in t) for t in own.tokens]
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return None
        return list(zip(own.ids, a_bytes)), list(zip(ids, b_bytes))

    return tokens


def brute(rows, tokens):
    links, out = {}, {}
    for k, (_, text) in enumerate(rows):
        both = tokens(text or "")
        if not both:
            out[k] = (0, 0, 0, "")
            continue
        spans = []
        for side in both:
            at, own = 0, []
            for i, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        parts, start = [], 0
        for end in ends:
            parts.append("|".join(",".join(str(i) for i, s, e in own if start <= s < end) for own in spans))
            start = end
        links[k] = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if max(s, t) < min(e, f)]
        out[k] = (len(spans[0]), len(spans[1]), len(ends), hashlib.sha256(";".join(parts).encode()).hexdigest())
    counts = Counter(p for x in links.values() for p in x)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(row[0], *out[k][:3], len(links.get(k, ())), sum(counts[p] == most[p[1]] for p in links.get(k, ())), sum(counts[p] for p in links.get(k, ())), out[k][3])
            for k, row in enumerate(rows)]


def _key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


def test_query_equals_brute_force(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len(r.text or "") < 1500}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_cross_tokenizer"](spark, sf).collect()}
    assert len(got) == len(docs)
    # counts are over all documents: take them from the aligned pairs, and the rest from the double loop on shorter texts
    want = {r[0]: r for r in brute([(r.doc_id, r.text) for r in docs if r.doc_id in short], plain)}
    for d, w in want.items():
        assert (got[d][1:5], got[d][7]) == (w[1:5], w[7])


ROWS = [(1, "The quick brown fox."), (2, None), (3, ""), (4, " "), (5, "the quick  brown\nfox <|endoftext|> <s> x"), (5, "the quick  brown\nfox <|endoftext|> <s> x"),
        (None, "naïve café 日本語 \U0001f600 zero"), (7, "▁ is not a space"), (8, "tab\tand\r\nline \u0000 end"), (9, "é ﬁ   　x"),
        (10, "a" * 3000), (11, "அஆ ԱԲ"), (12, "quick brown quick brown fox"), (13, "﻿mark"), (14, "trail   ")]


@pytest.mark.parametrize("head", [1_000_000, 0, 12])
def test_odd_rows_and_both_ways_to_counts(spark, plain, head):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, key string").repartition(3)
    rows, _ = crosstok.aligned_scores(docs, A, B, WIDTH, head_pairs=head)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=_key) == sorted(brute(ROWS, plain), key=_key)
    assert crosstok.aligned_scores(docs.limit(0), A, B, WIDTH)[0].collect() == []


def test_a_very_long_text(spark):
    text = "some words, some numbers 12345 and naïve cafés; " * 40_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    row = next(r for r in crosstok.aligned_scores(docs, A, B, WIDTH)[0].collect() if r.doc_id == 1)
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_groups > 100_000


def test_gallop_is_a_lower_bound():
    rng = random.Random(4)
    for n, m, top in ((0, 5, 9), (1, 1, 3), (40, 1000, 2000), (1000, 3000, 4000), (3000, 3001, 10**9), (33, 64, 70)):
        a = np.array(sorted(rng.sample(range(1, top + 1), min(n, top))), np.int64)
        b = np.array(sorted(rng.sample(range(1, top + 1), min(m, top))), np.int64)
        assert crosstok.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()


def test_alignment_is_readable(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokens")], "doc_id long, text string")
    row = crosstok.align(docs, A, B, ["doc_id"]).collect()[0]
    a, b, first, last = (np.frombuffer(row[c], "<u4").astype(int) for c in ("a_ids", "b_ids", "first_b", "last_b"))
    names = crosstok.ByteLevel(open(A, "rb").read()).tokens, crosstok.Pieces(open(B, "rb").read()).tokens
    assert b"".join(names[0][i] for i in a) == b" unbelievable tokens" == b"".join(names[1][i] for i in b)
    of_a, of_b = crosstok.groups(a, b, first, last)
    assert set(of_a) == set(of_b) and json.dumps([int(x) for x in first]) and (first <= last).all()
