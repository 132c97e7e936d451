"""PartEnum set join beside brute force: the given texts, families around the threshold, the promise of the signatures, blocks, odd rows."""

import random

import numpy as np
import pytest
from pitpanel.llm import partenum
from pitpanel.llm.common import mix
from pitpanel.llm.rounds import grouped, joining, members_of, parities, possible, suspected
from pitpanel.llm.neardup import shingle_sets
from pitpanel.llm.registered import QUERIES
from test_neardup import _family, sets_of


def brute(rows, similar=85, k=4):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, s) in enumerate(sets):
        for j, t in sets[:p]:
            if s and t and 100 * len(s & t) >= similar * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.link(docs)[0].collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_ngram_jaccard_join"](spark, sf).collect()} == brute(rows)


def _edited(rng, size, changes, fresh):
    """Two sets of hashes of about this size, so many elements apart."""
    base = [next(fresh) for _ in range(size)]
    other = list(base)
    for _ in range(changes):
        kind = rng.randrange(3)
        if kind < 2 and len(other) > 1:
            other.pop(rng.randrange(len(other)))
        if kind > 0:
            other.append(next(fresh))
    return np.sort(np.array(base, np.uint64)), np.sort(np.array(other, np.uint64))


def test_every_similar_pair_shares_a_signature():
    rng = random.Random(3)
    fresh = iter(lambda: rng.getrandbits(64), None)
    seen, thin = 0, 0
    for trial in range(3000):
        size = rng.choice([*range(1, 40), 60, 100, 250, 700])
        x, y = _edited(rng, size, rng.randrange(0, max(2, size // 5)), fresh)
        both = len(np.intersect1d(x, y))
        owner, keys = partenum.signatures([x, y])
        mine, other = (set(keys[owner == i].tolist()) for i in (0, 1))
        if len(x) != both or len(y) != both:
            if 100 * both >= 85 * (len(x) + len(y) - both):
                seen += 1
                assert mine & other, (size, both)
            elif not both:
                assert not mine & other
        thin += len(mine) > 0 and len(mine) % 3 > 0
    assert seen > 700 and thin


def test_bands_cover_similar_sizes():
    for n in range(1, 3000):
        number, low, high = partenum.band_of(n)
        assert low <= n <= high and partenum.bands_of(n)[0][0] == number
        largest = n * 100 // 85
        assert partenum.band_of(largest)[0] in {b[0] for b in partenum.bands_of(n)}
        k = partenum.differences(high)
        assert partenum.group_count(k) * (partenum.ERRORS + 1) > k


def test_families_around_the_threshold(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(4000)]
    texts = [*_family(rng, words, 30, 1), *_family(rng, words, 30, 2), *_family(rng, words, 30, 4), *["Same Text here and there"] * 40, "same text HERE and there"]
    for n in (2, 5, 8, 9, 11, 16, 25, 40):  # short texts with one word more, less or changed
        base = [rng.choice(words) for _ in range(n)]
        texts += [" ".join(base), " ".join(base + ["end"]), " ".join(base[:-1]), " ".join(["start", *base]), " ".join([*base[:-1], "end"])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("block,sketched", [(3, False), (3, True), (50, True), (2000, False), (2000, True)])
def test_blocks_of_a_bucket_find_the_same(spark, block, sketched):
    rng = random.Random(30)
    words = [f"w{i}" for i in range(4000)]
    texts = [t for edits in (2, 6, 9) for t in _family(rng, words, 25, edits)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "rep long, text string").repartition(2)
    members = members_of(spark.createDataFrame([(7, i) for i, _ in rows] + [(8, i) for i, _ in rows[:40]], "key long, rep long"))[0]
    roots = {r.node: r.root for r in grouped(members, frame, lambda t: shingle_sets(t, 4), 80, sketched, block_rows=block)[0].collect()}
    assert {i: roots.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute(rows, 80).items()}


def _pairs_around(rng, similar):
    """Pairs of sets of 64-bit hashes with similarities on both sides of the threshold."""
    for n in (1, 2, 7, 31, 32, 33, 63, 64, 65, 300, 3000):
        for part in (0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 1.0):
            both = int(n * part)
            pool = rng.integers(0, 2**63, 2 * n + 1, np.uint64) * np.uint64(2) + np.uint64(1)
            pool = mix(np.unique(pool))
            yield pool[:n], pool[n - both : n - both + n]


def test_sketches_rule_out_no_similar_pair_and_most_others(spark):
    rng = np.random.default_rng(4)
    pairs = list(_pairs_around(rng, 80))
    sets = [s for pair in pairs for s in pair]
    signs = spark.createDataFrame([(i, len(s), parities(s).tolist()) for i, s in enumerate(sets)], "rep long, n long, bits array<long>")
    wanted = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a long, b long")
    left = {r.a // 2 for r in possible(wanted, signs, 80).collect()}
    for i, (x, y) in enumerate(pairs):
        both = len(np.intersect1d(x, y))
        share = both / (len(x) + len(y) - both)
        by_task = suspected([(1, 0, 0, True, k, k, len(s), parities(s)) for k, s in enumerate((x, y))], 80)
        assert (len(by_task) == 2) == (i in left)
        assert i in left or share < 0.8
        assert i not in left or share > 0.5


def test_sketches_of_sets_far_apart_in_size(spark):
    x, y = np.arange(32, dtype=np.uint64), np.arange(33, dtype=np.uint64)  # 64 and 128 cells, 32 of 33 in common
    assert len(parities(x)) == 1 and len(parities(y)) == 2
    assert sorted(suspected([(1, 0, 0, True, k, k, len(s), parities(s)) for k, s in enumerate((x, y))], 85)) == [0, 1]
    big = np.arange(1000, dtype=np.uint64)
    assert suspected([(1, 0, 0, True, k, k, len(s), parities(s)) for k, s in enumerate((x, big))], 85) == []
    assert suspected([(1, 0, 1, True, k, k, len(s), parities(s)) for k, s in enumerate((x, y))], 85) == []  # of the same block


def test_a_task_emits_only_links_that_join():
    same = np.arange(10, dtype=np.uint64)
    rows = [(1, 0, 0, True, i, i, same) for i in range(50)] + [(1, 0, 0, True, 99, 99, same + np.uint64(100))]
    assert len(joining(rows, 80)) == 49


def test_odd_rows(spark):
    long = "very long text indeed and so on " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "a b c d"), (8, "A\tB\nc  d"), (9, long), (10, long + "x"), (11, "É é É é"), (12, "é é é é")]
    assert found(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(1, "a b c d e", "z"), (1, "a b c d e", "z"), (None, "a b c d e", "z"), (None, None, "z"), (3, "a b c d e", "z")], "doc_id long, text string, rep string")
    out = sorted(((r.doc_id, r.component_id) for r in partenum.link(docs)[0].collect()), key=str)
    assert out == [(1, 1), (1, 1), (3, 1), (None, None), (None, None)]
    assert partenum.link(docs.limit(0))[0].collect() == []
