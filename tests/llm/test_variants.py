"""Spelling variants beside a comparison of all words: given texts, planted words, hot halves, odd rows."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pitpanel.llm import variants
from pitpanel.llm.registered import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return found


def one_away(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute(found, least=5):
    words = {w: n for w, n in found.items() if n >= least and len(w) >= 6}
    letters = set("".join(words))
    form, out = {}, []
    near = {w: [x for x in one_away(w, letters) if x in words] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[0])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(docs))
    assert len(want) > 3000 and sum(r[4] for r in want) > 100
    assert rows_of(QUERIES["op13_spelling_variants"](spark, sf)) == want


def _vocabulary(rng, letters, n, lengths):
    found = Counter()
    for _ in range(n):
        word = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        found[word] += rng.randrange(3, 2000)
        for _ in range(rng.randrange(4)):
            kind, at = rng.randrange(3), rng.randrange(len(word))
            word = word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind != 2) :]
            found[word] += rng.randrange(3, 300)
    return found


@pytest.mark.parametrize("letters,lengths,shard,block", [("ab", [6, 7, 8, 9], 50, 10**6), ("ab", [6, 7, 8], 10**6, 20), ("abcé", [6, 7, 12], 300, 40),
                                                         ("abcdefghij", [6, 9, 30], 10**6, 10**6)])
def test_dense_vocabularies_and_hot_halves(spark, letters, lengths, shard, block):
    found = _vocabulary(random.Random(len(letters) + block), letters, 300, lengths)
    counts = spark.createDataFrame(list(found.items()), "word string, n long").repartition(3)
    assert rows_of(variants.group_variants(counts, shard=shard, block=block)[0]) == brute(found)


def test_chains_lead_to_their_last_form(spark):
    chain = [("formata", 5), ("formatb", 25), ("formbtb", 125), ("fcrmbtb", 625), ("fcrmbtbs", 3125), ("gcrmbtbs", 15625), ("gcrmbtes", 80_000)]
    out = {r.word: r.root for r in variants.group_variants(spark.createDataFrame(chain, "word string, n long"))[0].collect()}
    assert set(out.values()) == {"gcrmbtes"}


def test_odd_rows(spark):
    long = "colour " * 200_000
    rows = [(1, None), (2, ""), (3, "Colour COLOUR colour colour"), (None, "color colour Ünicode"), (4, long), (4, long), (5, "color colors " * 7 + "x" * 40), (6, "colonr " * 9),
            (7, ("y" * 300 + " ") * 6), (8, "1colour2colour_colour-colour"), (9, "Éclair éclair éClair éclair éclaír " * 5)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    found = variants.word_counts(docs)
    assert {r.word: r.n for r in found.collect()} == dict(counted(rows))
    assert rows_of(variants.group_variants(found)[0]) == brute(counted(rows))
    assert variants.group_variants(variants.word_counts(docs.limit(0)))[0].collect() == []


def test_search_of_one_shard():
    rng = random.Random(6)
    words = sorted(_vocabulary(rng, "abc", 150, [6, 7, 8, 9, 10]))
    words = [w for w in words if len(w) >= 6]
    rng.shuffle(words)
    index = variants.Index(words)
    got = {True: set(), False: set()}
    for left in got:
        for q, hit in index.near(words, left):
            got[left] |= {(words[a], words[b]) for a, b in zip(q.tolist(), hit.tolist())}
    known = set(words)
    for left in got:
        half = {w: (len(w) - 1) // 2 for w in words}
        want = {(u, v) for u in words for v in one_away(u, "abc") & known if (u[: half[u]] == v[: half[u]] if left else u[len(u) - half[u] :] == v[len(v) - half[u] :])}
        assert got[left] == want


def test_index_counts_symbols_above_a_row_from_one_comparison():
    words = [np.frombuffer(bytes(w), np.uint8) + 1 for w in np.random.default_rng(5).integers(0, 4, (60, 7), np.uint8)]
    side = variants.Direction(words, 5)
    rows = np.arange(side.n)
    for s in range(5):
        symbol = np.full(side.n, s, np.int64)
        assert side.same(symbol, rows).tolist() == [int((side.bwt[:r] == s).sum()) for r in rows]
        assert side.fewer(symbol, rows).tolist() == [int((side.bwt[:r] < s).sum()) for r in rows]
        low, high = side.extend(symbol, np.zeros(side.n, np.int64), rows)
        assert (high - low).tolist() == side.same(symbol, rows).tolist()


def test_runs_too_short_for_a_word_are_not_looked_at():
    assert variants.RUN.findall("short Größere abcde abcdef1ghijkl x") == ["Größere", "abcdef", "ghijkl"]
