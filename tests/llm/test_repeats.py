"""Substring dedup beside brute force."""

import hashlib
import random
import re

import pytest

from pitpanel.llm import repeats
from pitpanel.llm.registered import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    least = {}
    words = {i: WORD.findall(t or "") for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(i, least.get(g, i))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, kept string, n_words int")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(df)[0].collect()}


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_substring_dedup"](spark, sf).collect()}
    assert got == {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute(docs).items()}
    assert sum(m for _, m, _ in got.values()) > 0


@pytest.mark.parametrize("common,shard", [(1000, 50_000), (3, 40)])
def test_planted_passages(spark, monkeypatch, common, shard):
    monkeypatch.setattr(repeats, "COMMON", common)
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", shard)
    rng = random.Random(common)
    vocabulary = [f"w{i}" for i in range(40)] + ["a", "the", "é", "🙂"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(n) for n in (12, 13, 14, 20, 55, 90)]
    docs = []
    for i in range(80):
        body = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            body += p[a : len(p) - rng.randint(0, 4)] + say(rng.randint(0, 9))
        docs.append((i * 7 % 80, rng.choice([" ", "\n", "\t "]).join(body)))
    docs += [(200 + i, docs[5][1]) for i in range(12)] + [(300, "go " * 500), (301, "go " * 40), (302, "x " + "go " * 13)]
    assert run(spark, docs) == brute(docs)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(1, None), (2, ""), (3, " \n"), (4, passage), (5, passage + " end"), (6, "word " * 150_000 + passage), (7, "\x0b" + passage.replace(" ", "\x0c") + " x y")]
    assert run(spark, docs) == brute(docs)
    df = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (1, passage + " more"), (None, passage), (2, passage)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in repeats.remove_repeats(df)[0].collect()), key=str)
    assert out == [(1, 15, 0), (1, 15, 0), (1, 16, 0), (2, 15, 15), (None, 15, 0), (None, 15, 0)]
    assert repeats.remove_repeats(df.limit(0))[0].collect() == []
