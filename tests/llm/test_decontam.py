"""Decontamination: planted items, items with other numbers and names, and documents that must stay."""

import pytest

from pitpanel.llm import decontam
from pitpanel.llm.registered import QUERIES

ITEMS = [(1, "A farmer near the river has 24 sheep and sells 7 of them to his neighbour Tom for 30 dollars each, how much does he get?"),
         (2, "The quick brown fox jumps over the lazy dog while seven wise owls watch quietly from the old oak tree."),
         (3, "Too short to count."), (4, None), (None, ""), (2, "The quick brown fox jumps over the lazy dog while seven wise owls watch quietly from the old oak tree.")]


def flagged(spark, docs, monkeypatch=None):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    df = spark.createDataFrame([(i, t, "x", True) for i, t in docs], "doc_id int, text string, item_id string, kept boolean")
    found, _ = decontam.matches(df, bench)
    judged = decontam.judge(df, found)
    assert judged.columns == df.columns and judged.count() == len(docs)
    return {(r.doc_id, r.item_id, r.changed_slots) for r in found.collect()}, {r.doc_id for r in judged.collect() if not r.kept}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_planted_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", most)
    farmer, fox = ITEMS[0][1], ITEMS[1][1]
    other = farmer.replace("24", "1,350").replace("7 of", "19 of").replace("Tom", "Anna").replace("30", "4.5")
    docs = [(1, f"Intro words here. {farmer} And more."), (2, f"Well then. {other} The end."), (3, "x y z " + " ".join(fox.split()[3:17]) + " tail"),
            (4, " ".join(fox.split()[3:15])), (5, farmer.replace("sheep", "goats").replace("neighbour", "cousin")), (6, fox.upper()), (7, "the " * 5000 + fox), (8, "Plain clean text about nothing."),
            (9, "For For For " * 30), (10, "10 km 20 km 30 km " * 20), (11, fox.replace(" ", "\n"))]
    found, gone = flagged(spark, docs)
    assert gone == {1, 2, 3, 6, 7, 11}
    assert (1, 1, 0) in found and (2, 1, 4) in found and {i for _, i, _ in found} == {1, 2}


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "take 5 red beads and put 5 more red beads into the box then take 8 beads out again slowly")], "item_id int, text string")
    say = "take {} red beads and put {} more red beads into the box then take {} beads out again slowly".format
    docs = spark.createDataFrame([(1, say(5, 5, 8)), (2, say(7, 7, 2)), (3, say(7, 6, 2)), (4, say(9, 9, 9))], "doc_id int, text string")
    assert {r.doc_id for r in decontam.matches(docs, bench)[0].filter("run > 15").collect()} == {1, 2, 4}


def test_odd_rows(spark):
    fox = ITEMS[1][1]
    docs = [(None, fox), (1, fox), (1, fox), (1, "clean words of the same id"), (2, None), (3, ""), (4, " \n"), (5, "12 " * 100_000)]
    found, gone = flagged(spark, docs)
    assert found == {(None, 2, 0), (1, 2, 0)} and gone == {None, 1}
    df = spark.createDataFrame([], "doc_id int, text string")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontam.matches(df, bench)[0].collect() == []
    full = spark.createDataFrame([(1, fox)], "doc_id int, text string")
    assert [r.kept for r in decontam.judge(full, decontam.matches(full, bench.limit(0))[0]).collect()] == [True]


def test_both_forms_of_tokens_line_up(spark):
    texts = ["In May 3.5 km, 12 kg and 7%: Mr Bean's B2 x.5 5.x 1/2 a,b", "É 10km Ünder der Ñ 5 °C", "3:30 pm. at O'Neil, Mc-Donald 1,000.50!"]
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(decontam.tokens(F.col("t"), False).alias("a"), F.transform(decontam.tokens(F.col("t"), True), decontam._template).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_query_finds_every_whole_item(spark, sf):
    items = [r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: " " + " ".join(r.text.split()) + " " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    holds = {d for d, t in docs.items() if any(" " + " ".join(i) + " " in t for i in items)}
    windows = {tuple(i[k : k + 8]) for i in items for k in range(len(i) - 7)}
    near = {d for d, t in docs.items() if any(tuple(w[k : k + 8]) in windows for w in [t.split()] for k in range(len(w) - 7))}
    gone = {r.doc_id for r in QUERIES["op4_decontamination"](spark, sf).collect() if not r.kept}
    assert holds <= gone <= near


def hits(spark, items, docs):
    bench = spark.createDataFrame(items, "item_id int, text string")
    return {(r.doc_id, r.item_id): r.run for r in decontam.matches(spark.createDataFrame(docs, "doc_id int, text string"), bench)[0].collect()}


def test_consistent_stretches_of_an_inconsistent_run_count(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    w[5] = w[35] = "5"
    other = [*w[:35], "6", *w[36:]]
    roles = "she buys {} ripe apples at the market and pays {} whole dollars for them all before noon today".format
    early = "take {} red beads and then {} blue beads away from me and hide the rest at home".format  # only a stretch between the cuts is long enough
    mixed = ["1", "2", "aa", "1", *(f"x{chr(97 + i)}" for i in range(12))]
    docs = [(1, " ".join(other)), (2, roles(7, 9)), (3, early(7, 9)), (4, " ".join(["3", "2", "aa", "4", *mixed[4:]])), (5, " ".join(["8", *mixed[1:12], "end"]))]
    got = hits(spark, [(1, " ".join(w)), (2, roles(5, 5)), (3, early(5, 5)), (4, " ".join(mixed))], docs)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4)} and got[1, 1] == 35


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_dense_short_and_reflowed_items_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", most)
    monkeypatch.setattr(decontam, "WINDOWS_A_TASK", 1)
    dense = "add up {} {} {} {} {} {} then write the whole result".format
    series = "1 1 2 3 5 8 13 21 34 55 89 144 233 377"
    named = "yesterday {} walked with {} over the long bridge to see {} and {} again".format
    items = [(1, dense(1, 2, 3, 4, 5, 6)), (2, series), (3, "What is the capital of Peru?"), (4, named("Ann", "Bob", "Cid", "Dan")), (None, "one item without any id that has more than a dozen words in it"), (6, "Why?")]
    docs = [(k, "pad " * k + dense(9, 8, 7, 11, 12, 13)) for k in range(6)]
    docs += [(10 + k, "pad " * k + series) for k in range(7)]
    docs += [(20, "He asked: WHAT is\nthe capital  of peru"), (21, "what is the capital of Chile, in Peru"), (22, "\n".join(named("Eve", "Fay", "Gus", "Hal").split())), (23, named("Eve", "Fay", "Gus", "Hal").replace(" ", " \t")),
             (24, series.replace("13", "14")), (25, "pad one item without any id that has more than a dozen words in it"), (26, "and why not")]
    got = hits(spark, items, docs)
    assert set(got) == {(k, 1) for k in range(6)} | {(10 + k, 2) for k in range(7)} | {(20, 3), (22, 4), (23, 4), (25, None), (26, 6)}
    assert got[10, 2] == 14 and got[20, 3] == 6
