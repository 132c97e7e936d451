"""Fuzzy line dedup: one line of each group of similar lines stays, the first by document and line number.

Lines are compared as sets of character shingles of the lower-cased line. Min-hash bands propose, the exact Jaccard similarity
decides, and components over the links are the groups. Equal lines are one node of that graph from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.rounds import grouped, members_of
from pitpanel.llm.common import SEPARATORS, drop, mix, powers, slices, store

#: Characters of a shingle; a shorter line is one shingle. Similarity of a link in hundredths.
SHINGLE, SIMILAR = 8, 80
#: 18 bands of 3 values miss a pair at similarity 0.8 with a probability of 2e-6.
BANDS, ROWS = 18, 3
#: Bytes of text signed at a time. The arrays of a slice have several numbers a character, and all of them should stay in a core's cache.
SIGN_BYTES = 1 << 17
#: Lines a task remembers, by hash, to sign each but once.
SEEN = 1 << 17

_SEEDS = np.random.default_rng(9)
_A = _SEEDS.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Whether a code point is part of a word; the last place stands for all others.
_IN_WORD = np.ones(34, bool)
_IN_WORD[[*SEPARATORS, ord("\n")]] = False


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind a line feed, and the offset of that line feed."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any span follows."""
    power, inverse = powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
    return total, inverse


def _shingles(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each line, where each line's begin, and a hash of each whole line."""
    total, inverse = _sums(points)
    length = np.minimum(ends - starts, SHINGLE)
    n = ends - starts - length + 1
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts - first[:-1], n) + np.arange(first[-1])
    size = np.repeat(length, n)
    grams = (total[at + size] - total[at]) * inverse[at]
    whole = mix((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))
    return grams, first[:-1], whole


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each line as sorted hashes."""
    lines = [t.lower() for t in texts.to_pylist()]
    points, offsets = _points(lines)
    starts, ends = offsets[:-1] + 1, offsets[1:]
    grams, first, _ = _shingles(points, starts, np.maximum(ends, starts))
    grams, bounds = mix(grams), [*first.tolist(), len(grams)]
    for a, b in zip(bounds, bounds[1:]):
        grams[a:b].sort()
    once = np.ones(len(grams), bool)
    once[1:] = grams[1:] != grams[:-1]
    once[first] = True
    kept = np.concatenate([[0], np.cumsum(once)])[bounds].tolist()
    grams = grams[once]
    return [grams[a:b] for a, b in zip(kept, kept[1:])]


def _lines(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Lower-cased code points, and for each line with a word: its text, its number there, start and end."""
    points, offsets = _points([low if len(low := t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts])
    feeds = np.flatnonzero(points == 10)
    starts, ends = feeds[:-1] + 1, feeds[1:]
    doc = np.searchsorted(offsets, starts - 1, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[doc] + 1)
    words = np.concatenate([[0], np.cumsum(_IN_WORD[np.minimum(points, 33)])])
    some = words[ends] > words[starts]
    return points, doc[some], number[some], starts[some], ends[some]


def _sign(texts: list[str], seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each line with a word: its text, number, two hashes; then which lines are the first with their hash here, and the band keys of those.

    Hashes that ``seen`` holds came before; new ones are put there, each in the one place it can have. A hash that another drives out is
    signed again when it returns, which costs time only.
    """
    points, doc, number, starts, ends = _lines(texts)
    if not len(doc):
        return doc, number, doc.astype(np.int64), doc.astype(np.int64), doc.astype(bool), np.zeros((0, BANDS), np.int64)
    grams, first, whole = _shingles(points, starts, ends)
    second = mix(np.add.reduceat(mix(grams), first) + whole)
    names, heads = np.unique(whole, return_index=True)
    place = (names & np.uint64(len(seen) - 1)).astype(np.int64)
    new = seen[place] != names
    seen[place[new]] = names[new]
    fresh = np.zeros(len(doc), bool)
    fresh[heads[new]] = True
    if not new.any():
        return doc, number, whole.view(np.int64), second.view(np.int64), fresh, np.zeros((0, BANDS), np.int64)
    own = np.concatenate([first, [len(grams)]])
    sizes = np.diff(own)[fresh]
    grams, first = grams[np.repeat(fresh, np.diff(own))], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    short = ((grams ^ (grams >> np.uint64(29))) * _ODD >> np.uint64(32)).astype(np.uint32)
    keys, permuted, k = np.zeros((len(first), BANDS), np.uint64), np.empty_like(short), 0
    for band in range(BANDS):
        key = np.full(len(first), band, np.uint64)
        for _ in range(ROWS):
            np.multiply(short, _A[k], out=permuted)
            key = key * _ODD + np.minimum.reduceat(permuted, first)
            k += 1
        keys[:, band] = mix(key)
    return doc, number, whole.view(np.int64), second.view(np.int64), fresh, keys.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents as (doc_id, text_hash, text); the hash tells rows apart that share an id but not the text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).filter("text is not null")


def _signed(keyed: DataFrame) -> DataFrame:
    schema = T.StructType([keyed.schema["doc_id"], *T._parse_datatype_string("text_hash long, line int, node long, check long, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.arange(SEEN, dtype=np.uint64) ^ np.uint64(1)  # no hash has its place there
        for batch in batches:
            for part in slices(batch, 2, SIGN_BYTES):
                doc, number, node, check, fresh, bands = _sign(part.column(2).to_pylist(), seen)
                at = pa.array(doc)
                # offsets with NULLs: a line that an earlier one of the slice repeats has no bands
                offsets = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~fresh, False)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number.astype(np.int32)),
                                                  pa.array(node), pa.array(check), lists], names=schema.fieldNames())

    return keyed.mapInArrow(run, schema)


def _texts_of(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the wanted lines, each read from the first document that has it."""
    firsts = nodes.join(wanted, nodes.node == wanted.rep).select("rep", F.col("first").alias("m"))
    by_doc = firsts.groupBy(F.col("m.doc_id").alias("d"), F.col("m.text_hash").alias("h")).agg(F.collect_list(F.struct(F.col("m.line").alias("line"), "rep")).alias("take"))
    rows = keyed.join(by_doc, keyed.doc_id.eqNullSafe(by_doc.d) & (keyed.text_hash == by_doc.h)).select("take", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                reps, texts = [], []
                for take, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = text.split("\n")
                    reps += [x["rep"] for x in take]
                    texts += [own[x["line"]] for x in take]
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(texts, pa.string())], names=["rep", "text"])

    return rows.mapInArrow(run, "rep long, text string").dropDuplicates(["rep"])


def group_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """One row for each line with a word, and the scratch paths behind it.

    doc_id, text_hash, line (counted from 0 between line feeds), group (equal for similar lines), n_in_group, kept (the first of its group by
    doc_id, text_hash, line, with NULL ids first). A NULL text has no lines; blank lines are in no group. Rows that repeat id and text
    are one document. Should two different lines ever share the 64-bit hash that names them, both stay. Other columns are not looked at.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text)
    signed, p_signed = store(_signed(keyed), "line-signed")
    where = F.min(F.struct("doc_id", "text_hash", "line")).alias("first")
    clash = (F.min("check") != F.max("check")).alias("clash")
    nodes, p_nodes = store(signed.groupBy("node").agg(where, F.count(F.lit(1)).alias("n"), clash, F.first("bands", True).alias("bands")), "line-nodes")
    lines, p_lines = store(signed.select("doc_id", "text_hash", "line", "node"), "lines")
    drop(spark, p_signed)
    members, p_members = members_of(nodes.select(F.explode("bands").alias("key"), F.col("node").alias("rep")))
    texts, p_texts = store(_texts_of(keyed, nodes, members.select("rep").distinct()), "line-texts")
    roots, p_roots = grouped(members, texts, shingle_sets, SIMILAR, sketched=True)
    named = nodes.select("node", "first", "n", "clash").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    named, p_named = store(named.select("node", "first", "n", "clash", "group"), "line-named")
    heads, p_heads = store(named.filter("not clash").groupBy("group").agg(F.min("first").alias("head"), F.sum("n").alias("n_in_group")), "line-groups")
    heads_of, p_heads_of = store(named.join(heads, "group", "left").select("node", "group", "clash", "head", "n_in_group"), "line-heads")
    drop(spark, p_nodes, p_members, p_texts, *p_roots, p_named, p_heads)
    own = F.struct("doc_id", "text_hash", "line")
    out = lines.join(heads_of, "node")
    kept = F.col("clash") | own.eqNullSafe(F.col("head"))
    return out.select("doc_id", "text_hash", "line", "group", F.when(F.col("clash"), F.lit(1)).otherwise(F.col("n_in_group")).alias("n_in_group"), kept.alias("kept")), [p_lines, p_heads_of]


def without_lines(docs: DataFrame, grouped_lines: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that are not kept taken out of the text. A document all of whose lines go is left out.

    Texts that lose nothing, NULLs and blank texts included, stay as they are, and so do all other columns.
    """
    gone = grouped_lines.groupBy(F.col("doc_id").alias("_d_"), F.col("text_hash").alias("_h_")).agg(
        F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("_gone_"), F.max("kept").alias("_some_"))
    schema = docs.schema
    names = schema.fieldNames()
    joined = docs.withColumn("_hash_", F.xxhash64(text)).join(gone, F.col(id_col).eqNullSafe(F.col("_d_")) & (F.col("_hash_") == F.col("_h_")), "left")
    joined = joined.filter(F.coalesce("_some_", F.lit(True)))
    others = [c for c in names if c != text]

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                new = []
                for gone_, body in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    drop_ = set(gone_ or ())
                    new.append("\n".join(x for i, x in enumerate(body.split("\n")) if i not in drop_) if drop_ else body)
                cols = {c: part.column(i) for i, c in enumerate(others)} | {text: pa.array(new, pa.string())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return joined.select(*others, "_gone_", F.col(text).alias("_body_")).mapInArrow(run, schema)
