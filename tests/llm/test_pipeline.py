"""Each stage of the pipeline beside a plain version on its own input, and rows that are odd."""

import base64

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_lines import brute as plain_lines
from test_neardup import brute as plain_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert k == 4 or docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_language_keeps_clean_documents(results):
    kept = {r.doc_id for r in results[1]}
    assert all((r.doc_id in kept) == any(c.isalpha() for c in r.text or "") for r in results[0])


def test_lines_equal_a_plain_version(results):
    groups = plain_lines([(r.doc_id, r.text) for r in results[1]])
    want = {}
    for r in results[1]:
        lines = list(enumerate(r.text.split("\n")))
        left = [x for n, x in lines if groups.get((r.doc_id, n), (r.doc_id, n)) == (r.doc_id, n)]
        if any(groups.get((r.doc_id, n)) == (r.doc_id, n) for n, _ in lines) or all((r.doc_id, n) not in groups for n, _ in lines):
            want[r.doc_id] = ("\n".join(left), len("\n".join(left)))
    assert {r.doc_id: (r.text, r.n_chars) for r in results[2]} == want and len(want) < len(results[1])


def test_near_duplicates_equal_a_plain_version(results):
    groups = plain_near([(r.doc_id, r.text) for r in results[2]], 5)
    assert sorted(r.doc_id for r in results[3]) == sorted(i for i, (_, root) in groups.items() if root == i)


def test_leaks_go_and_nothing_else(results, spark, sf):
    items = [r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(i[k : k + 13]) for i in items for k in range(len(i) - 12)}
    close = {tuple(i[k : k + 8]) for i in items for k in range(len(i) - 7)}
    words = {r.doc_id: r.text.split() for r in results[3]}
    holds = {d for d, w in words.items() if any(tuple(w[k : k + 13]) in windows for k in range(len(w) - 12))}
    near = {d for d, w in words.items() if any(tuple(w[k : k + 8]) in close for k in range(len(w) - 7))}
    gone = set(words) - {r.doc_id for r in results[4]}
    assert holds <= gone <= near


def test_tokens_equal_the_public_library(results):
    with open(P.path(corpus_pipeline.RANK_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r for r in results[4]}
    assert len(results[5]) == len(texts)
    for r in results[5]:
        doc = texts[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(doc.text) and r.round_trip and (r.lang, r.source) == (doc.lang, doc.source)


def test_run_gives_the_rows_of_the_last_stage(results, spark, sf):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, results[5]))


def test_odd_rows_pass_every_stage(spark, sf):
    words = " ".join(f"wort{i} haus" for i in range(30))
    rows = [(None, words, "de", "s", 1, True, 0.1, "r"), (None, None, None, None, None, None, None, None), (1, "the cat sat on the mat and then some more of it", "en", "s", 2, False, 0.2, "r"),
            (1, "the cat sat on the mat and then some more of it", "en", "s", 2, False, 0.2, "r"), (2, "", "en", None, 3, True, None, "r"), (3, "123 !!", None, "s", 4, True, 0.3, "r"),
            (4, "very long text of words " * 50_000, "en", "s", 5, None, 0.4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, row string")
    for start in (docs, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            alone = stage(spark, start, sf)
            now = stage(spark, now, sf)
            assert k == 4 or (now.columns == docs.columns and alone.columns == docs.columns)
            assert alone.count() <= len(rows)
            now = spark.createDataFrame(now.collect(), now.schema)
        assert sorted((r.doc_id for r in now.collect()), key=str) == ([1, 1, 4, None] if start is docs else [])
