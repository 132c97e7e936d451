"""The queries of these operators over the sample tables, and their SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import bpe, chat, crosstok, decontam, langid, lines, neardup, partenum, quality, repeats, shards, urls, variants
from pitpanel.llm.common import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANK_FILE = "byte_bpe_50k.tiktoken"


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_bpe(spark, sf_dir):
    """Ids of every document and the bytes they decode to, as digests."""
    vocabulary = public_tokenizers.path(RANK_FILE)
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, ["doc_id"])
    tokens = tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(tokens, vocabulary, ["doc_id"], ["n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


SHARDS = 40


@query
def op3_sharding(spark, sf_dir):
    """Every document in one of 40 shards of nearly equal bytes, and its place there.

    Slots are dealt to shards blindly (version 0 of the map), then the map is balanced by the bytes counted (version 1).
    """
    docs = _table(spark, sf_dir, "documents")
    records, _ = store(docs.select(
        "doc_id", shards.record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        shards.slot_of(F.col("doc_id"), F.col("text")).alias("slot"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards.PARTS)).cast("int").alias("part")), "shard-records")
    slot_bytes = records.groupBy("slot").agg(F.sum("size").alias("bytes"))
    blind = shards.first_map(spark, SHARDS)
    versions, _ = store(blind.unionByName(shards.rebalance(blind, slot_bytes, SHARDS)), "shard-map")
    placed = shards.positions(shards.assign(records, versions.filter("version = 1")), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))


HELD_OUT = "coalesce(pmod(crc32(cast(doc_id as string)), 5) = 0, false)"


@query
def op5_language_id(spark, sf_dir):
    """The language of every document, learned from four fifths of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~F.expr(HELD_OUT)))
    return model.predict(docs, ["doc_id"]).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


@query
def op6_quality(spark, sf_dir):
    """Base measures and the verdict of line-first cleaning for every document."""
    return quality.measure(_table(spark, sf_dir, "documents"), ["doc_id"]).drop("cleaned")


@query
def op7_chat(spark, sf_dir):
    """All conversations as windows, and what the windows say when they are read back."""
    marks = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], turns.schema)
    return chat.read_back(chat.format_windows(turns.unionByName(tricky)))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op8_url_filter(spark, sf_dir):
    """Every page's verdict: by the longest rule that fits its URL, else by trees trained on the URLs that rules decide."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rule, verdict = urls.fitting_rule(urls.host_of(F.col("url")), urls.path_of(F.col("url")), URL_RULES)
    trees = urls.fit(pages.select("url", verdict.alias("verdict")), "url", "verdict")
    judged = trees.judge(pages, ["page_id"], "url")
    rule, verdict = urls.fitting_rule(F.col("host"), F.col("path"), URL_RULES)
    by_trees = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "p_block")


@query
def op10_near_dedup(spark, sf_dir):
    """Groups of documents that are linked by similar sets of four-word shingles."""
    return neardup.cluster(_table(spark, sf_dir, "documents"), k=4)[0]


@query
def op9_line_dedup(spark, sf_dir):
    """Every line of the documents with its group of similar lines, and whether it is the one that stays."""
    return lines.group_lines(_table(spark, sf_dir, "documents"))[0]


@query
def op2_substring_dedup(spark, sf_dir):
    """Every document without the words of passages that an earlier document has."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))[0]
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query
def op4_decontamination(spark, sf_dir):
    """Every document, whether it stays, and the benchmark item it shares most with."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = decontam.matches(docs, _table(spark, sf_dir, "benchmark"))
    most = found.groupBy("doc_id", "text_hash").agg(F.max(F.struct("run", "item_id", "slots", "changed_slots")).alias("m"))
    own = decontam.judge(docs, found).select("doc_id", F.xxhash64("text").alias("text_hash"), "kept")
    return own.join(most, ["doc_id", "text_hash"], "left").select("doc_id", "kept", "m.item_id", "m.run", "m.slots", "m.changed_slots")


@query
def op11_ngram_jaccard_join(spark, sf_dir):
    """Groups of documents linked by a Jaccard similarity of 0.85 of their four-word shingles."""
    return partenum.link(_table(spark, sf_dir, "documents"))[0]


PIECES = 32_000


@query
def op12_cross_tokenizer(spark, sf_dir):
    """Every document cut where the tokens of two vocabularies end together, and how common its linked id pairs are."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstok.aligned_scores(_table(spark, sf_dir, "documents"), *files, PIECES)[0]


@query
def op13_spelling_variants(spark, sf_dir):
    """Every frequent word of the documents, its more frequent variant, and the end of that chain."""
    return variants.group_variants(variants.word_counts(_table(spark, sf_dir, "documents")))[0]


@query
def pipeline(spark, sf_dir):
    """The whole corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


ORACLES["op2_substring_dedup"] = f"""WITH d AS (SELECT doc_id, {_WORDS.format("COALESCE(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM d, LATERAL (SELECT UNNEST(range(1, len(ws) - 11)) AS i) t),
earliest AS (SELECT g, MIN(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT win.doc_id, list(DISTINCT i + k) AS p FROM win JOIN earliest USING (g), range(13) r(k) WHERE lo < win.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(COALESCE(len(p), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(COALESCE(p, []), i)), ' ')) AS kept_sha256 FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id"""

_SYMBOL = "regexp_extract_all({}, '[#*$%&|<>]')"
_GAPS = "len(regexp_extract_all(trim(l), '[ \\t]+'))"
ORACLES["op6_quality"] = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, {_WORDS.format("COALESCE(text, '')")} AS ws,
  list_filter(string_split(COALESCE(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT UNNEST(range(1, len(ws) - 3)) AS i) t),
twice AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING COUNT(*) > 1),
covered AS (SELECT win.doc_id, COUNT(DISTINCT i + k) AS n FROM win JOIN twice ON twice.doc_id = win.doc_id AND twice.g = win.g, range({quality.WINDOW}) r(k) GROUP BY 1),
good AS (SELECT doc_id, list_filter(ls, lambda l: NOT (length(l) - length(replace(l, '|', '')) >= {quality.MENU_BARS}
  OR 100 * len({_SYMBOL.format("l")}) > {quality.MOST_SYMBOLS} * length(l)
  OR (NOT regexp_matches(l, '[.!?…。！？:;]["”’»)\\]]*[ \\t\\r]*$') AND {_GAPS} BETWEEN {quality.FRAGMENT_WORDS[0] - 1} AND {quality.FRAGMENT_WORDS[1] - 1})
  OR (regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}') AND {_GAPS} >= {quality.SHOUTED_WORDS - 1})
  OR regexp_matches(lower(l), '{"|".join(quality.BOILERPLATE)}'))) AS gs FROM d),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len({_SYMBOL.format("t")}) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(gs) AS BIGINT) AS n_lines_removed,
  CASE WHEN len(ls) > 0 THEN 100e0 * length(array_to_string(gs, '')) / length(array_to_string(ls, '')) ELSE 0e0 END AS left_percent
  FROM d JOIN good ON good.doc_id = d.doc_id LEFT JOIN covered ON covered.doc_id = d.doc_id)
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AND left_percent >= {quality.LEAST_LEFT} AS kept FROM m"""

_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components_sql(similar: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM d, LATERAL (SELECT UNNEST(range(1, len(ws) - 2)) AS i) t
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3) x),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON b.g = a.g AND b.doc_id > a.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {similar} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
roots AS (SELECT a, MIN(LEAST(a, b)) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(root, d.doc_id) AS component_id FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN roots ON roots.a = d.doc_id"""


ORACLES["op10_near_dedup"] = f"SELECT *, component_id = doc_id AS kept FROM ({_components_sql(80)}) x"
ORACLES["op11_ngram_jaccard_join"] = _components_sql(partenum.SIMILAR)
