"""Near-duplicates beside brute force: planted copies, hot groups, both ways past the first round, and odd rows."""

import random
import re

import pyarrow as pa
from pitpanel.llm import neardup
from pitpanel.llm.components import connected
from pitpanel.llm.registered import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, s) in enumerate(sets):
        for j, t in sets[:p]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def check(spark, rows, k=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.cluster(docs, k=k)[0].collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op10_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 4)


def _family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


def test_families_of_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [*_family(rng, words, 40, 1), *_family(rng, words, 25, 3), *["Same Text here and there"] * 30, *["same text HERE and there"] * 5,
             *(" ".join(rng.choice(words) for _ in range(60)) for _ in range(40))]
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # neighbours are similar, ends are not
        texts.append(" ".join(chain[step * 3 :] + [f"d{i}" for i in range(step * 3)]))
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_buckets_that_round_one_leaves_open(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(90)]
    texts = []
    for _ in range(30):  # texts that share most of a passage, in pairs of near copies
        own = common + [rng.choice(words) for _ in range(40)]
        texts += [" ".join(own), " ".join(own[:-1] + ["end"])]
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    long = "very long text indeed " * 60_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "a b c d"), (8, "A\tB\nc  d"), (9, long), (10, long + "x"), (11, "É é É é"), (12, "é é é é")]
    check(spark, rows)
    docs = spark.createDataFrame([(1, "a b c d e", "z"), (1, "a b c d e", "z"), (None, "a b c d e", "z"), (None, None, "z"), (3, "a b c d e", "z")], "doc_id long, text string, kept string")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.cluster(docs, k=4)[0].collect()), key=str)
    assert out == [(1, 1, True), (1, 1, True), (3, 1, False), (None, None, True), (None, None, True)]
    assert neardup.cluster(docs.limit(0))[0].collect() == []


def test_posterior_bounds():
    tests = neardup.least_matches(16, 96, 0.8, 1e-6)
    assert [n for n, _ in tests] == [16, 32, 48, 64, 80, 96] and all(0 <= m < n * 0.8 for n, m in tests)
    assert [m for _, m in tests] == sorted(m for _, m in tests)
    assert all(m >= n for (_, m), (_, n) in zip(neardup.least_matches(16, 96, 0.8, 1e-2), tests))


def test_band_sharing_follows_similarity():
    rng = random.Random(2)
    pool = [f"x{i}" for i in range(100_000)]
    agree = []
    for _ in range(60):
        a = [rng.choice(pool) for _ in range(203)]
        b = list(a)
        b[100] = "other"
        s = [neardup._sign(pa.array([" ".join(t)]), 4)[3][0].as_py() for t in (a, b)]
        agree.append(sum(s[0][i : i + 4] == s[1][i : i + 4] for i in range(0, len(s[0]), 4)) / 96)
    assert abs(sum(agree) / len(agree) - 196 / 204) < 0.01


def test_components_of_long_chains_and_hot_nodes(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 400)] + [(399, 3), (7, 7), (None, 8), (9, 10), (10, 9)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in (3, 5, *range(200, 400))}, 9: 9, 10: 9}
