"""Language identification with Bloom filters that answer for all languages at once.

A filter cell holds one bit for each language. The frequent n-grams of a language set its bit in a few cells; the
AND of an n-gram's cells names every language that may contain it. A text goes to the language with most n-grams, after the share
of n-grams that its filter would accept by chance is taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.common import over_text, slices, utf8

UNKNOWN = "und"
#: Different labelled texts used for each language, about (a fixed share by hash of the text).
SAMPLE_TEXTS = 2_000
#: An n-gram is a language's own if it makes up this share of the n-grams of its texts, each text counting one once. So a language
#: has 1 / LEAST_SHARE of them at most.
LEAST_SHARE = 1 / 30_000
MOST_LANGUAGES = 64
BITS = 20
# Odd multipliers of the three hash functions.
_HASHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
_BLANK = np.uint32(0x20202020)

_FOLD = np.full(256, 32, np.uint8)  # bytes of ASCII letters and of all other scripts stay, the rest becomes a blank
for _c in (*range(97, 123), *range(128, 256)):
    _FOLD[_c] = _c


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte n-grams of each text between blanks, lower-cased, and the bounds of each text in them."""
    padded = pc.binary_join_element_wise("  ", pc.utf8_lower(texts), "  ", "")
    data, offsets = utf8(padded)
    data = _FOLD[data]
    wide = np.zeros(len(data) + 3, np.uint32)
    wide[: len(data)] = data
    every = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    fits = every != _BLANK
    for k in (1, 2, 3):  # n-grams that would reach into the next text
        fits[offsets[1:] - k] = False
    bounds = np.concatenate([[0], np.cumsum(fits)])[offsets]
    return every[fits], bounds


def _cells(found: np.ndarray) -> list[np.ndarray]:
    return [(found * np.uint32(h)) >> np.uint32(32 - BITS) for h in _HASHES]


@dataclass
class LanguageFilter:
    languages: list[str]
    cells: np.ndarray
    by_chance: np.ndarray

    def predict(self, docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """The key columns, ``lang_pred`` and ``score``, from whole texts alone.

        ``und`` and 0 if the text is NULL or has no letter, or nothing was learned. The score is the share of the text's
        n-grams that the language contains. Ties go to the first language by name; rows that repeat are judged each.
        """
        shared = docs.sparkSession.sparkContext.broadcast((self.languages, self.cells, self.by_chance))
        fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        return over_text(docs, keys, text, fields, lambda: lambda texts: _judge(texts, *shared.value))


def _judge(texts: pa.Array, languages: list[str], cells: np.ndarray, by_chance: np.ndarray) -> list[pa.Array]:
    found, bounds = grams(texts)
    n = np.diff(bounds)
    shares = np.zeros((len(texts), max(1, len(languages))))
    masks = np.bitwise_and.reduce([cells[i] for i in _cells(found)]) if len(found) else np.zeros(0, cells.dtype)
    for k in range(len(languages)):
        has = np.concatenate([[0], np.cumsum((masks >> cells.dtype.type(k)) & cells.dtype.type(1), dtype=np.int64)])
        hits = has[bounds[1:]] - has[bounds[:-1]]
        shares[:, k] = np.maximum(0, hits - n * by_chance[k]) / (1 - by_chance[k]) / np.maximum(n, 1)
    best = shares.argmax(axis=1)
    known = np.array([bool(languages)]) & _has_letter(texts)
    names = np.array([*languages, UNKNOWN], object)[np.where(known, best, len(languages))]
    score = np.where(known, np.minimum(shares[np.arange(len(texts)), best], 1.0), 0.0)
    return [pa.array(names, pa.string()), pa.array(score, pa.float64())]


def _has_letter(texts: pa.Array) -> np.ndarray:
    ascii_ = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~ascii_):
        ascii_[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return ascii_


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE_TEXTS) -> LanguageFilter:
    """Fill the filter from labelled texts; rows without text or language are left out.

    About ``sample`` different texts of each language are used, chosen by a hash of the text; of those, whole texts count, each once
    however many copies it has. What the driver receives is at most 1 / LEAST_SHARE n-grams for each of at most ``MOST_LANGUAGES`` languages.
    """
    known = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    texts = known.select("lang", F.xxhash64("text").alias("text_hash")).distinct()
    counts = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in counts)
    dtype = np.uint8 if len(languages) <= 8 else np.uint64
    cells = np.zeros(1 << BITS, dtype)
    if not languages:
        return LanguageFilter([], cells, np.zeros(0))
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], min(1.0, sample / r["count"])) for r in counts))
    chosen = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).distinct()

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found, bounds = grams(part.column(1))
                which = pc.index_in(part.column(0), pa.array(languages)).to_numpy(zero_copy_only=False).astype(np.uint64)
                texts = np.repeat(np.arange(len(which), dtype=np.uint64), np.diff(bounds))
                once = np.unique(texts << np.uint64(32) | found)  # a text counts an n-gram once, however long it is
                both, n = np.unique(which[once >> np.uint64(32)] << np.uint64(32) | once & np.uint64(2**32 - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((both >> np.uint64(32)).astype(np.int32)), pa.array((both & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["k", "gram", "n"])

    by_gram = chosen.mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    totals = by_gram.groupBy("k").agg(F.sum("n").alias("total"))  # one row a language
    frequent = by_gram.join(F.broadcast(totals), "k").filter(F.col("n") >= F.col("total") * LEAST_SHARE).select("k", "gram").toPandas()
    for k in range(len(languages)):
        for at in _cells(frequent.gram[frequent.k == k].to_numpy().astype(np.uint32)):
            cells[at] |= dtype(1 << k)
    filled = np.array([((cells >> dtype(k)) & dtype(1)).mean() for k in range(len(languages))])
    return LanguageFilter(languages, cells, filled ** len(_HASHES))
