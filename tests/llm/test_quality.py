"""Quality measures beside a plain count, and rules line by line."""

import re
from collections import Counter

from pitpanel.llm import quality
from pitpanel.llm.registered import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def count(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def _got(rows):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}


def test_query_equals_a_plain_count(spark, sf):
    got = _got(QUERIES["op6_quality"](spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: count(d.text) for d in docs}


def test_odd_texts(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "f ends with f f", "\x0ca b\x0bc\x0c", "a b c d e a b c d e", "x y z w v " * 30_000, "naïve 🙂 é\u00a0é",
             "\\ \\t [^ ]", "one\n\n \none\none\ntwo", "# * $ % & | < >", "a a a a a a a", "l'a \"b\" 'c'"]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in enumerate(texts)], "doc_id int, text string, n_words int, kept string")
    rows = quality.measure(docs, ["doc_id"]).collect()
    assert _got(rows) == {i: count(t) for i, t in enumerate(texts)}
    assert not rows[0].kept and rows[0].cleaned == ""


def test_lines_that_fail(spark):
    good = "This is a plain sentence that goes on for more than ten words, as prose does."
    bad = ["Home | About | News | Contact", "### $$$ %%% &&&", "We use a cookie to make this work.", "BUY THIS NOW OR NEVER!", "A menu of things"]
    cut_off = "word " * 40
    docs = spark.createDataFrame([(0, "\n".join([good, *bad, good + " Again.", cut_off.strip()])), (1, "\n".join([good, *(f"Page {i} | Part {i * i} | Item {i}" for i in range(9))]))],
                                 "doc_id int, text string")
    rows = {r.doc_id: r for r in quality.measure(docs, ["doc_id"]).collect()}
    assert rows[0].cleaned.split("\n") == [good, good + " Again.", cut_off.strip()] and rows[0].n_lines_removed == 5
    assert not rows[1].kept and not rows[1].base_failed


def test_labelled_documents(spark, sf):
    rows = QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_no_rows(spark):
    assert quality.measure(spark.createDataFrame([], "doc_id int, text string"), ["doc_id"]).collect() == []
