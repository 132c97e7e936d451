"""From raw documents to token ids: language, lines, near-duplicates, benchmark leaks, tokens.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. ``run`` writes each result as Parquet to the shared folder
and reads it again as the next stage's documents. All stages but the last return the columns of documents, others that came along included.
A stage given ``scratch`` lists there the tables its result still reads, so that they can be deleted once the result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import bpe, decontam, langid, lines, neardup
from pitpanel.llm.common import drop, store

#: A document goes if its best language has fewer of its n-grams than this share.
LEAST_SCORE = 0.2
RANK_FILE = "byte_bpe_50k.tiktoken"
#: SQL can state neither the language filters nor the merges.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[str] | None = None) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach. NULL texts and texts without letters go."""
    model = langid.learn(docs)
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.col("text").alias("body"))
    judged = model.predict(rows, ["row", "body"], "body")
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("body").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[str] | None = None) -> DataFrame:
    """Documents without lines that an earlier one has, about; those left without any go. ``n_chars`` is counted anew."""
    grouped, paths = lines.group_lines(docs)
    _note(scratch, paths)
    out = lines.without_lines(docs, grouped)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(out.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[str] | None = None) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    clustered, paths = neardup.cluster(docs)
    _note(scratch, paths)
    return docs.join(clustered.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[str] | None = None) -> DataFrame:
    """Documents that share no run of words with an item of the benchmark."""
    found, paths = decontam.matches(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    _note(scratch, paths)
    return decontam.clean(docs, found)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[str] | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text again."""
    vocabulary = public_tokenizers.path(RANK_FILE)
    carry = ["lang", "source", "text_sha256"]
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"), "text")
    tokens = bpe.encode(rows, vocabulary, public_tokenizers.PATTERN, ["doc_id", *carry])
    back = bpe.decode(tokens.withColumn("own", F.col("ids")), vocabulary, ["doc_id"], [*carry, "n_tokens", "own"])
    return back.select("doc_id", "lang", "source", "n_tokens", F.col("own").alias("ids"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenise", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), []
    for name, stage in STAGES:
        scratch: list[str] = []
        docs, path = store(stage(spark, docs, sf_dir, scratch), f"pipeline-{name}")
        drop(spark, *before, *scratch)
        before = [path]
    return docs


def _note(scratch: list[str] | None, paths: list[str]) -> None:
    if scratch is not None:
        scratch.extend(paths)
