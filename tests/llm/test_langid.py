"""Language filters: held-out accuracy, and texts that are odd."""

import random
import zlib

from pitpanel.llm import langid
from pitpanel.llm.registered import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    learned = spark.createDataFrame([("the quick brown fox jumps over the lazy dog", "en"), ("der schnelle braune fuchs springt", "de"), (None, "fr"), ("zzz", None)] * 3,
                                    "text string, lang string")
    model = langid.learn(learned)
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 !?", "—…", "the brown fox", "schnelle fuchs", "日本語", "the brown fox", "a", "the lazy dog " * 100_000]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id int, text string, score double, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in model.predict(docs, ["doc_id"]).collect()}
    assert [got[i] for i in range(4)] == [("und", 0.0)] * 4
    assert got[4][0] == "en" and got[5][0] == "de" and got[6] == ("de", 0.0) and got[7] == got[4] and got[8][0] in model.languages and got[9][0] == "en"


def test_nothing_learned_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    model = langid.learn(empty)
    assert model.predict(empty, ["doc_id"]).collect() == []
    docs = spark.createDataFrame([(1, "words"), (1, "words")], "doc_id int, text string")
    assert [tuple(r) for r in model.predict(docs, ["doc_id"]).collect()] == [(1, "und", 0.0)] * 2


def test_copies_of_a_text_weigh_no_more_than_the_text(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)) for _ in range(60)]
    alone, copied = (langid.learn(spark.createDataFrame([(t, "en") for t in [*texts, *texts[:1] * n]], "text string, lang string"), sample=sample)
                     for n, sample in ((0, 60), (3000, 60)))
    assert (alone.cells == copied.cells).all() and alone.cells.sum() > 5000
