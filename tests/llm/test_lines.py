"""Fuzzy lines beside brute force, and documents without their repeated lines."""

import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from pitpanel.llm import lines, rounds
from pitpanel.llm.registered import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(docs):
    """(doc_id, line) -> first line of its group, from plain sets of shingles."""
    rows = sorted((i, n, x) for i, t in docs if t is not None for n, x in enumerate(t.split("\n")) if WORD.search(x))
    sets, inverted, parent = [], {}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (_, _, x) in enumerate(rows):
        x = x.lower()
        own = {x[i : i + 8] for i in range(max(1, len(x) - 7))}
        met = {}
        for g in own:
            for j in inverted.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            inverted[g].append(k)
        sets.append(own)
        for j, both in met.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(j), find(k)))
                parent[b] = a
    return {rows[k][:2]: rows[find(k)][:2] for k in range(len(rows))}


def heads(out):
    first = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.line)):
        first.setdefault(r.group, (r.doc_id, r.line))
    return {(r.doc_id, r.line): first[r.group] for r in out}


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op9_line_dedup"](spark, sf).collect()
    want = brute(docs)
    assert heads(out) == want
    assert all(r.kept == (want[r.doc_id, r.line] == (r.doc_id, r.line)) for r in out)
    sizes = {}
    for k in want.values():
        sizes[k] = sizes.get(k, 0) + 1
    assert all(r.n_in_group == sizes[want[r.doc_id, r.line]] for r in out)


@pytest.mark.parametrize("block", [4, 20, 2000])
def test_families_of_lines_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "grouped", partial(rounds.grouped, block_rows=block))
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for _ in range(4):
        base = "".join(rng.choice(letters) for _ in range(120)).strip() + "."
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(letters[:-1])
            rows.append("".join(own))
    docs = list(enumerate(rows))
    out = lines.group_lines(spark.createDataFrame(docs, "doc_id long, text string"))[0].collect()
    assert heads(out) == brute(docs)


def test_planted_lines_and_cleaned_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    base = " ".join(word() for _ in range(25))
    docs = []
    for i in range(60):
        near = base[:40] + rng.choice("xyz") + base[41:] if i % 2 else base.upper()
        docs.append((i, "\n".join([" ".join(word() for _ in range(12)), near, "", "menu", f"É unique {word()} {word()} {word()}"])))
    docs.append((60, base))
    docs.append((61, None))
    df = spark.createDataFrame([(i, "s", t, "k", 5) for i, t in docs], "doc_id long, line string, text string, kept string, n_chars int")
    grouped, _ = lines.group_lines(df)
    out = grouped.collect()
    assert heads(out) == brute(docs)
    clean = {r.doc_id: r for r in lines.without_lines(df, grouped).collect()}
    assert set(clean) == {i for i, _ in docs} - {60} and clean[0].line == "s" and clean[0].kept == "k"
    assert clean[0].text == docs[0][1] and clean[61].text is None
    own = docs[5][1].split("\n")
    assert clean[5].text == "\n".join([own[0], "", own[4]])


def test_odd_rows(spark):
    rows = [(None, "same line here"), (None, "same line here"), (1, "same line here\nother"), (1, "different text of one id"), (1, ""), (2, " \n\t\r"), (3, None),
            (4, "x\n" * 50_000), (5, "İstanbul ẞ ﬁ"), (5, "long " * 200_000), (6, "\n\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grouped, _ = lines.group_lines(docs)
    out = grouped.collect()
    assert len(out) == 1 + 1 + 2 + 1 + 50_000 + 2 + 1
    assert sorted((str(r.doc_id), r.line) for r in out if r.kept) == sorted(
        [("None", 0), ("None", 0), ("1", 1), ("1", 0), ("4", 0), ("5", 0), ("5", 0), ("6", 2)])
    clean = sorted(((r.doc_id, r.text) for r in lines.without_lines(docs, grouped).collect()), key=str)
    assert (1, "other") in clean and (1, "") in clean and (2, " \n\t\r") in clean and (4, "x\n") in clean and len(clean) == len(rows)
    empty = docs.limit(0)
    assert lines.group_lines(empty)[0].collect() == [] and lines.without_lines(empty, lines.group_lines(empty)[0]).collect() == []


def test_no_pair_at_the_threshold_is_missed(spark):
    rng = random.Random(8)
    docs = []
    for i in range(3000):  # one character of 80: similarity 65 / 81
        own = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)]
        docs.append((i, "".join(own) + "\n" + "".join([*own[:40], "-", *own[41:]])))
    out = lines.group_lines(spark.createDataFrame(docs, "doc_id long, text string"))[0].collect()
    assert len(out) == 6000 and {(r.n_in_group, r.kept) for r in out} == {(2, True), (2, False)}


def test_a_task_signs_each_line_once():
    """A line that came in an earlier slice has no bands again; a hash driven out of its place only costs a repeat."""
    texts = ["one line of some length\nanother line of it", "another line of it\nOne Line of some length"]
    seen = np.arange(lines.SEEN, dtype=np.uint64) ^ np.uint64(1)
    first, again = lines._sign(texts[:1], seen), lines._sign(texts[1:], seen)
    assert first[4].all() and first[5].shape == (2, lines.BANDS)
    assert not again[4].any() and again[5].shape == (0, lines.BANDS)
    assert set(first[2]) == set(again[2])
    one = np.arange(1, dtype=np.uint64) ^ np.uint64(1)
    both = [lines._sign([t], one) for t in texts]
    assert all(b[4].any() for b in both) and {tuple(x) for x in both[0][5]} == {tuple(x) for x in first[5]}


def test_only_rows_of_shared_keys_leave_the_task():
    """Runs of a key that cross batches, empty batches, and keys at either end."""
    rng = random.Random(4)
    for _ in range(200):
        keys = sorted(rng.choices(range(12), k=rng.randint(0, 14)))
        cuts = [0, *sorted(rng.choices(range(len(keys) + 1), k=4)), len(keys)]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(range(a, b), pa.int64())], names=["key", "rep"])
                   for a, b in zip(cuts, cuts[1:])]
        out = [x for b in rounds._shared(iter(batches)) for x in b.column(1).to_pylist()]
        assert out == [i for i, k in enumerate(keys) if keys.count(k) > 1]


def test_sketches_rule_pairs_out_before_texts_travel(spark, monkeypatch):
    """Lines that share bands but are not similar are not verified on their texts; those that are similar still meet."""
    tested = []
    kept = rounds.verified
    monkeypatch.setattr(rounds, "verified", lambda pairs, *rest: tested.append(pairs.count()) or kept(pairs, *rest))
    rng = random.Random(5)
    common = [rng.choice("abcdefghij") for _ in range(120)]
    # each keeps a different two thirds of one line: many bands are shared, no pair is similar
    texts = ["".join(common[:80] + [rng.choice("klmnopqrst") for _ in range(40)]) for _ in range(30)]
    texts += ["".join(common) + "x", "".join(common) + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lines.group_lines(docs)[0].collect()
    assert heads(out) == brute(list(enumerate(texts)))
    assert sum(tested) <= 10
