"""Set similarity join by PartEnum signatures: every pair of similar sets shares a signature, without any chance of a miss.

Sizes are cut into bands. Two sets of a band at the wanted Jaccard similarity differ in ``k`` elements at most. The domain of elements is hashed into
groups of ``PARTS`` parts, so many groups that one of them holds ``ERRORS`` differences or fewer; of that group some subset of ``PARTS - ERRORS`` parts is
equal in both sets. All such subsets of all groups are enumerated, and the elements that a set has in a subset make one signature.

A subset in which a set has no element says nothing and is left out. That loses no pair while one of the two sets has more groups with over
``ERRORS`` filled parts than differences can spoil; the rare sets that have not ("thin" ones) add their first ``k + 1`` elements in the order of hashes as
signatures, of which two similar sets always share one. A set is in the band of its size and in those above from which a similar set can come.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.rounds import grouped, members_of
from pitpanel.llm.common import drop, mix, over_text, slices, store
from pitpanel.llm.neardup import shingle_sets

#: Words of a shingle, and similarity of a link in hundredths.
SHINGLE, SIMILAR = 4, 85
#: Parts of a group, differences that a group may hold, and how much the sizes of a band grow.
PARTS, ERRORS, GROWTH = 3, 1, 1.5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_of(size: int) -> tuple[int, int, int]:
    """(number, least and largest size) of the band of a size."""
    number, low, high = 0, 1, 1
    while size > high:
        number, low = number + 1, high + 1
        high = max(low, int(low * GROWTH))
    return number, low, high


def bands_of(size: int, similar: int = SIMILAR) -> list[tuple[int, int, int]]:
    """The bands in which a set of this size can meet a similar one: its own, and those of the larger sets."""
    out = [band_of(size)]
    while out[-1][2] < size * 100 // similar:
        out.append(band_of(out[-1][2] + 1))
    return out


def differences(largest: int, similar: int = SIMILAR) -> int:
    """In how many elements two similar sets of at most this size differ at most."""
    return 2 * largest * (100 - similar) // (100 + similar)


def group_count(k: int) -> int:
    """Groups of a band: enough that one holds ERRORS differences or fewer, and a few more, so that thin sets are rare."""
    least = k // (ERRORS + 1) + 1
    return least + 1 + least // 32


def signatures(sets: list[np.ndarray], similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for all sets of hashes; sets of one band are worked on together."""
    by_band: dict[tuple[int, int, int], list[int]] = {}
    for i, s in enumerate(sets):
        for band in bands_of(len(s), similar) if len(s) else ():
            by_band.setdefault(band, []).append(i)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for (number, _, high), own in by_band.items():
        k = differences(high, similar)
        if not k:
            continue  # only equal sets are similar here, and equal sets are one
        groups = group_count(k)
        cells = groups * PARTS
        sizes = np.array([len(sets[i]) for i in own], np.int64)
        elements = np.concatenate([sets[i] for i in own])
        salt = mix(np.array([number + 1], np.uint64) * _ODD)[0]
        spread = mix(elements ^ salt)
        at = np.repeat(np.arange(len(own)) * cells, sizes) + (spread % np.uint64(cells)).astype(np.int64)
        filled = (np.bincount(at, minlength=len(own) * cells) > 0).reshape(len(own), groups, PARTS)
        sums = np.zeros(len(own) * cells, np.uint64)
        np.add.at(sums, at, mix(spread + _ODD))
        sums = sums.reshape(len(own), groups, PARTS)
        for c, subset in enumerate(combinations(range(PARTS), PARTS - ERRORS)):
            some = filled[:, :, subset].any(axis=2)
            names = mix((np.arange(groups, dtype=np.uint64) * np.uint64(64) + np.uint64(c)) * _ODD + salt)
            i, g = np.nonzero(some)
            owners.append(np.array(own)[i])
            found.append(mix(sums[:, :, subset].sum(axis=2, dtype=np.uint64)[i, g] + names[g]))
        thin = np.flatnonzero((filled.sum(axis=2) > ERRORS).sum(axis=1) * (ERRORS + 1) <= k)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for i in thin:
            first = np.sort(spread[starts[i] : starts[i + 1]])[: k + 1]
            owners.append(np.full(len(first), own[i]))
            found.append(mix(first + (salt ^ _ODD)))
    return np.concatenate(owners), np.concatenate(found)


def _fingerprints(texts: pa.Array, k: int) -> list[pa.Array]:
    """Size and two hashes of each text's set."""
    sets = shingle_sets(texts, k)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = [np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)]
    full = sizes > 0
    if full.any():
        every = np.concatenate([s for s in sets if len(s)])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[0][full] = np.add.reduceat(mix(every), starts)
        out[1][full] = np.bitwise_xor.reduceat(mix(every + _ODD), starts)
    return [pa.array(sizes), *(pa.array(x.view(np.int64)) for x in out)]


def _keyed(texts: DataFrame, k: int, similar: int) -> DataFrame:
    """(key, rep) for all signatures of the sets of (rep, text)."""
    schema = T.StructType([T.StructField("key", T.LongType()), texts.schema["rep"]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                owner, found = signatures(shingle_sets(part.column(1), k), similar)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), part.column(0).take(pa.array(owner))], names=["key", "rep"])

    return texts.select("rep", "text").mapInArrow(run, schema)


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, similar: int = SIMILAR) -> tuple[DataFrame, list[str]]:
    """One row for each row of ``docs``: id, n_shingles (distinct k-word shingles), component_id (least id reachable over links). And scratch paths.

    A link takes ``similar`` hundredths of the union. Words are lower-cased in A-Z only; texts of fewer than k words are one shingle. A NULL text counts as
    empty; texts without words and rows without an id are linked with nothing. Rows that repeat an id are one document: a link of
    either counts for both. Texts with the same set are one class, of which the least id is compared. Other columns are not looked at.
    """
    spark = docs.sparkSession
    fields = [T.StructField(n, T.LongType()) for n in ("n_shingles", "fp1", "fp2")]
    slim = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text"))
    signed, p_signed = store(over_text(slim, ["rep"], "text", fields, lambda: lambda t: _fingerprints(t, k)), "sets")
    same = ["n_shingles", "fp1", "fp2"]
    classes, p_classes = store(signed.filter("n_shingles > 0 and rep is not null").groupBy(*same).agg(F.min("rep").alias("rep")), "set-classes")
    texts, p_texts = store(slim.filter("text is not null").join(classes.select("rep").distinct(), "rep", "left_semi"), "set-texts")
    members, p_members = members_of(_keyed(texts, k, similar))
    some, p_some = store(texts.join(members.select("rep").distinct(), "rep", "left_semi"), "set-candidates")
    drop(spark, p_texts)
    roots, p_roots = grouped(members, some, lambda t: shingle_sets(t, k), similar, sketched=True)
    labels, p_labels = store(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("component")), "set-labels")
    drop(spark, p_members, p_some, p_classes, *p_roots)
    out = signed.join(labels, same, "left")
    component = F.when(F.col("rep").isNotNull(), F.coalesce("component", "rep"))
    return out.select(F.col("rep").alias(id_col), "n_shingles", component.alias("component_id")), [p_signed, p_labels]
