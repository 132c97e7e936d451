"""Substring dedup: words of passages that an earlier document already has are removed.

A window is ``WINDOW`` consecutive words. Every window holds an anchor: the ``GRAM`` consecutive words of least hash in it. Equal
windows have equal anchors, so only windows whose anchor occurs in two documents or more can recur.

1. Anchors are counted. A document keeps the list of those of its anchors that recur.
2. The words around such an anchor, as far as windows reach that have it as theirs, form a segment. Segments are routed by anchor, and
   those of a very common anchor window by window, so that no route holds more than a bounded number of different texts.
   Equal segments become one row with their least document.
3. A task takes routes in turn, up to ``SHARD_WINDOWS`` windows at a time: this is a shard. Windows that two of its rows hold
   are confirmed, compiled into an Aho-Corasick automaton with their least document, and the rows are streamed through it, which locates
   every occurrence. One symbol of the automaton is one whole word, so matches are exact.
4. Located windows go back to the documents, and their words out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.common import Words, drop, slices, store, utf8

WINDOW, GRAM = 13, 5
#: Documents that may share an anchor before its windows are routed one by one.
COMMON = 1_000
#: Windows of one automaton.
SHARD_WINDOWS = 50_000
_REACH = WINDOW - GRAM + 1


class _Windows:
    """All windows of several texts: their text, first word, anchor and the place of the anchor."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        words = Words(data, offsets)
        hashes = words.hashes()
        grams, bounds = words.grams(hashes, GRAM)
        counts = np.maximum(np.diff(words.bounds) - (WINDOW - 1), 0)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(bounds[:-1] - self.bounds[:-1], counts) + np.arange(self.bounds[-1])
        self.anchor, self.place = grams[at] if len(at) else np.zeros(0, np.uint64), at.copy()
        for j in range(1, _REACH):
            other = grams[at + j]
            less = other < self.anchor
            self.anchor = np.where(less, other, self.anchor)
            self.place = np.where(less, at + j, self.place)
        self.words, self.hashes = words, hashes

    def whole(self) -> np.ndarray:
        """Hashes of whole windows."""
        return self.words.grams(self.hashes, WINDOW)[0]


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id): the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = _Windows(part.column(1))
                own = [np.unique(found.anchor[a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:])]
                at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), part.column(0).take(at)], names=["anchor", "doc_id"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, T.StructType([T.StructField("anchor", T.LongType()), slim.schema["doc_id"]]))


_SEGMENT = "route long, start int, windows int, words string"


def _segments(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, route, start, windows, words) of documents with lists ``rare`` and ``common`` of recurring anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4):
                texts, found = part.column(4), _Windows(part.column(4))
                whole = found.whole()
                rows, route, start, n, words = [], [], [], [], []
                for k, (rare, common) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    a, b = found.bounds[k], found.bounds[k + 1]
                    anchor, place = found.anchor[a:b].view(np.int64), found.place[a:b]
                    alone = np.isin(anchor, common or [])
                    use = alone | np.isin(anchor, rare or [])
                    new = np.ones(b - a, bool)
                    new[1:] = (place[1:] != place[:-1]) | alone[1:]
                    first = np.flatnonzero(new)
                    length = np.diff(np.append(first, b - a))
                    first, length = first[use[first]], length[use[first]]
                    own = texts[k].as_py().encode().split()  # on the six separators, as bytes do
                    rows += [k] * len(first)
                    route.append(np.where(alone[first], whole[a:b].view(np.int64)[first], anchor[first]))
                    start.append(first)
                    n.append(length)
                    words += [b" ".join(own[i : i + m + WINDOW - 1]) for i, m in zip(first.tolist(), length.tolist())]
                if rows:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(route)), pa.array(np.concatenate(start).astype(np.int32)),
                         pa.array(np.concatenate(n).astype(np.int32)), pa.array(words, pa.binary()).cast(pa.string())], names=schema.fieldNames())

    slim = docs.select("doc_id", "text_hash", "rare", "common", "text")
    schema = T.StructType([*slim.schema.fields[:2], *T._parse_datatype_string(_SEGMENT).fields])
    return slim.mapInArrow(run, schema)


def _locate(rows: list[tuple]) -> list[list[int]]:
    """For each (words, least document): the windows in it whose least document is smaller."""
    import ahocorasick

    symbols: dict[bytes, str] = {}
    spelled = []
    for words, _ in rows:
        spelled.append("".join(symbols.get(w) or symbols.setdefault(w, _symbol(len(symbols))) for w in words.split()))
    least: dict[str, tuple] = {}
    recurring = set()
    for text, (_, doc) in zip(spelled, rows):
        for i in range(len(text) - WINDOW + 1):
            window = text[i : i + WINDOW]
            seen = least.get(window)
            if seen is None:
                least[window] = doc
            elif seen != doc:
                recurring.add(window)
                least[window] = min(seen, doc)
    if not recurring:
        return [[] for _ in rows]
    automaton = ahocorasick.Automaton()
    for window in recurring:
        automaton.add_word(window, least[window])
    automaton.make_automaton()
    return [[end - WINDOW + 1 for end, doc in automaton.iter(text) if doc < own] for text, (_, own) in zip(spelled, rows)]


def _symbol(n: int) -> str:
    return chr(n + 256 if n + 256 < 0xD800 else n + 256 + 0x800)


def _located(distinct: DataFrame) -> DataFrame:
    """(route, mark, first, gone) of distinct segments (route, words, first, last) that lose windows in any document."""
    slim = distinct.select("route", F.xxhash64("words").alias("mark"), "first", (F.col("first") < F.col("last")).alias("more"), F.encode("words", "UTF-8").alias("words"))
    ordered = slim.repartition("route").sortWithinPartitions("route")
    schema = T.StructType([*slim.schema.fields[:3], *T._parse_datatype_string("gone array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, group, shard, size = None, [], [], 0

        def solve():
            located = iter(_locate([(r[4], r[2]) for r in shard if r[5]]))
            out = [(*r[:3], next(located) if r[5] else [], r[3]) for r in shard]
            out = [r for r in out if r[3] or r[4]]
            cols = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kinds),
                                               pa.array(cols[3], pa.list_(pa.int32()))], names=schema.fieldNames())

        def close():  # a route with one segment has nothing to be searched for
            shard.extend((*r, len(group) > 1) for r in group)
            return sum(r[4].count(b" ") for r in group) if len(group) > 1 else len(group)

        for batch in batches:
            kinds = batch.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    size += close()
                    group = []
                    if size > SHARD_WINDOWS:
                        yield solve()
                        shard, size = [], 0
                group.append(row)
        if group:
            close()
        if shard:
            yield solve()

    return ordered.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """One row for each row of ``docs``: id, n_words, n_removed, kept (the words that stay, one space between). And scratch paths.

    A word goes if a window over it also starts in a document with a smaller id; windows are judged on the texts as they came. Words are
    what stands between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns. A NULL text has no words. Rows without an
    id are compared with nothing, and rows with equal ids are not compared with each other. Other columns are not looked at.
    """
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = every.filter("doc_id is not null")
    anchors = _anchors(known)
    recurring, p_recurring = store(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
                                   .filter("lo < hi").select("anchor", (F.col("n") > COMMON).alias("common")), "repeats-anchors")
    lists, p_lists = store(anchors.join(recurring, "anchor").groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("common"), F.col("anchor"))).alias("rare"), F.collect_list(F.when(F.col("common"), F.col("anchor"))).alias("common")), "repeats-lists")
    segments, p_segments = store(_segments(known.join(lists, "doc_id")), "repeats-segments")
    distinct = segments.groupBy("route", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    located, p_located = store(_located(distinct), "repeats-located")
    places = segments.select("doc_id", "text_hash", "route", F.xxhash64("words").alias("mark"), "start", "windows").join(located, ["route", "mark"])
    places = places.filter((F.col("doc_id") > F.col("first")) | (F.size("gone") > 0)).select(
        "doc_id", "text_hash", F.struct("start", F.when(F.col("doc_id") > F.col("first"), F.col("windows")).otherwise(0).alias("n"),
                                        F.when(F.col("doc_id") <= F.col("first"), F.col("gone")).alias("gone")).alias("place"))
    removed, p_removed = store(places.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places")), "repeats-removed")
    drop(spark, p_recurring, p_lists, p_segments, p_located)
    joined = every.join(removed.withColumnRenamed("text_hash", "h").withColumnRenamed("doc_id", "d"), (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return _without(joined.select(F.col("doc_id").alias(id_col), "places", "text")), [p_removed]


def _without(rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema.fields[0], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                total, removed, kept = [], [], []
                for places, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = text.encode().split()
                    edges = np.zeros(len(words) + 1, np.int64)
                    for p in places or ():
                        for i, n in [(p["start"], p["n"])] if p["n"] else [(p["start"] + g, 1) for g in p["gone"] or ()]:
                            edges[i] += 1
                            edges[i + n + WINDOW - 1] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    total.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if removed[-1] else b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
