"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how often ids meet in a corpus.

Both tokenizers cut the same bytes, so each gives a sorted list of byte offsets where tokens end. The shorter list drives a galloping
intersection: from where the previous offset fell, steps of doubling length go into the longer list until they pass the offset, and a
binary search ends between the last two steps. Common offsets cut both token lists into groups; the differences of neighbouring ranks
are the ranges of tokens that overlap a token. Many offsets are searched abreast: the shorter list is dealt to lanes of ``LANE`` neighbours,
whose heads are placed by the same search over every ``LANE``-th offset.

Counts of id pairs over the corpus are aggregated in the tasks before they are shuffled. Documents then read them back: the most frequent
pairs (``HEAD_PAIRS`` at most) from a broadcast, all others over a join by pair, so what is broadcast has a bound whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.common import SLICE_BYTES, drop, over_text, slices, store

LANE = 32
#: Pairs with their counts that are broadcast at most.
HEAD_PAIRS = 1_000_000
#: Distinct pairs that a task gathers before it hands on what it has counted.
GATHER = 2_000_000
#: Pieces of text kept with their ids between slices of texts.
PIECES = 200_000
_FAR = np.int64(2**62)
# How byte-level vocabularies split a text before they merge.
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Characters on which all engines agree what is a letter, a number, a space or neither.
_PLAIN = regex.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u205e]*")


class ByteLevel:
    """A byte-level vocabulary (tokenizer JSON): encodes space + text without special tokens.

    Merges never cross the pieces into which the pattern splits a text. Texts of plain characters are therefore split here, and each distinct piece is
    encoded by the library once while it is remembered (``PIECES`` at most); other texts go through the library whole.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(content)
        self.model.encode_special_tokens = True
        alphabet = _byte_alphabet()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        special = {t["content"] for t in json.loads(content).get("added_tokens", [])}
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.tokens = np.array(self.tokens, object)

        self.own_split = json.loads(content).get("pre_tokenizer") == _SPLITTER and self.model.normalizer is None
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        fresh = list(pieces.difference(self.known))
        if len(self.known) + len(fresh) > PIECES:
            self.known.clear()
            fresh = list(pieces)
        self.known.update(zip(fresh, self._library(fresh)))

    def _pieces(self, text: str) -> bytes:
        """A text in parts, so that never all pieces of a very long one are held."""
        found, out = _SPLIT.finditer(text), []
        while some := [m.group() for m in islice(found, PIECES // 2)]:
            self._learn(set(some))
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        every = [" " + t for t in texts]
        plain = [self.own_split and _PLAIN.fullmatch(t) is not None for t in every]
        split = [_SPLIT.findall(t) if p and len(t) < SLICE_BYTES else None for p, t in zip(plain, every)]
        self._learn(set().union(*(s for s in split if s)))
        whole = iter(self._library([t for p, t in zip(plain, every) if not p]))
        ready = [b"".join(map(self.known.__getitem__, s)) if s is not None else None for s in split]
        return [np.frombuffer(r if r is not None else self._pieces(t) if p else next(whole), "<u4") for r, p, t in zip(ready, plain, every)]


class Pieces:
    """A piece vocabulary with byte fallback (sentence-piece model), which puts the space before the text itself."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        self.tokens = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.tokens = np.array(self.tokens, object)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.model.encode(texts, num_threads=1)]


def gallop(values: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each of the ascending values, how many numbers of the ascending longer list are less."""
    n, m = len(values), len(longer)
    padded = np.append(longer, _FAR)
    out = np.zeros(n, np.int64)
    if n > LANE:
        at = gallop(values[::LANE], longer)
    else:
        at = np.zeros(min(n, 1), np.int64)
    lanes = len(at)
    for step in range(LANE if n > LANE else n):
        index = np.arange(lanes) * LANE + step
        index = index[index < n]
        at = at[: len(index)]
        wanted = values[index]
        low, high = at, at.copy()
        short = np.flatnonzero(padded[high] < wanted)
        low, leap = low.copy(), 1
        while len(short):
            low[short] = high[short] + 1
            high[short] = np.minimum(high[short] + leap, m)
            leap *= 2
            short = short[padded[high[short]] < wanted[short]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = padded[middle] < wanted[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        out[index] = at = low
    return out


def overlaps(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the shorter end list, the first and last token of the longer one that it shares bytes with, and whether both end there."""
    last = gallop(shorter, longer)
    common = longer[last] == shorter
    first = np.zeros(len(last), np.int64)
    first[1:] = last[:-1] + common[:-1]
    return first, last, common


def _turned(first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same overlaps seen from the n tokens of the other list."""
    tokens = np.arange(n)
    return np.searchsorted(last, tokens, "left"), np.searchsorted(first, tokens, "right") - 1


class _Aligner:
    def __init__(self, a_file: bytes, b_file: bytes):
        self.sides = ByteLevel(a_file), Pieces(b_file)
        self.lengths = [np.array([len(t) for t in s.tokens], np.int64) for s in self.sides]

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        every = texts.to_pylist()
        ids = [side.encode(every) for side in self.sides]
        whole = [(" " + t).encode() for t in every]
        good = [bool(t) and all(b"".join(side.tokens[own[d]].tolist()) == w for side, own in zip(self.sides, ids)) for d, (t, w) in enumerate(zip(every, whole))]
        sizes = np.array([[len(own[d]) if good[d] else 0 for d in range(len(every))] for own in ids], np.int64)
        flat = [np.concatenate([np.zeros(0, "<u4"), *(x for d, x in enumerate(own) if good[d])]).astype(np.int64) for own in ids]
        ends = [np.cumsum(n[f]) for n, f in zip(self.lengths, flat)]
        bounds = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
        first, last = np.zeros(len(flat[0]), np.int64), np.zeros(len(flat[0]), np.int64)
        # ends of all texts are one ascending list; texts whose list of side A is the shorter are searched together, the others as well
        for a_drives in (True, False):
            docs = (sizes[0] <= sizes[1]) == a_drives
            if not sizes[0][docs].any():
                continue
            own = [np.repeat(docs, s) for s in sizes]
            place = [np.flatnonzero(o) for o in own]
            if a_drives:
                f, l, _ = overlaps(ends[0][own[0]], ends[1][own[1]])
            else:
                f, l, _ = overlaps(ends[1][own[1]], ends[0][own[0]])
                f, l = _turned(f, l, len(place[0]))
            start = np.repeat(bounds[1][:-1], sizes[0])[own[0]]
            first[place[0]] = place[1][f] - start
            last[place[0]] = place[1][l] - start
        out = []
        for values, of in ((flat[0], 0), (flat[1], 1), (first, 0), (last, 0)):
            data = values.astype("<u4")
            offsets = (bounds[of] * 4).astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        return out


def align(docs: DataFrame, a_file: str, b_file: str, keys: list[str], text: str = "text") -> DataFrame:
    """For each row of ``docs``: the key columns, the ids of both tokenizers and the tokens that overlap, as little-endian unsigned 32-bit integers.

    ``a_ids`` and ``b_ids`` are the tokens of space + text; ``first_b`` and ``last_b`` hold, for each token of A, the first and last token of B that it
    shares bytes with. Rows with a NULL or empty text, or whose tokens do not give back the bytes of space + text on both sides, have no tokens.
    ``a_file`` is a byte-level tokenizer JSON, ``b_file`` a sentence-piece model with byte fallback, both readable by the driver (a few MB; broadcast).
    Rows that repeat are aligned each; other columns are not looked at.
    """
    context = docs.sparkSession.sparkContext
    files = []
    for name in (a_file, b_file):
        with open(name, "rb") as f:
            files.append(context.broadcast(f.read()))
    fields = [T.StructField(n, T.BinaryType()) for n in ("a_ids", "b_ids", "first_b", "last_b")]
    return over_text(docs, keys, text, fields, lambda: _Aligner(files[0].value, files[1].value))


def groups(a_ids: np.ndarray, b_ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of its group: tokens between two offsets at which both sides end."""
    opens = np.ones(len(first), bool)
    opens[1:] = first[1:] > last[:-1]
    of_a = np.cumsum(opens) - 1
    of_b = np.searchsorted(first[opens], np.arange(len(b_ids)), "right") - 1
    return of_a, of_b


class _Summary:
    """Counts, the written form of the groups, and the id pairs of each aligned text."""

    def __init__(self, width: int):
        self.width = width
        self.marks: dict[str, np.ndarray] = {}

    def _written(self, mark: str, ids: np.ndarray) -> np.ndarray:
        table = self.marks.get(mark)
        if table is None or len(table) <= ids.max():
            table = self.marks[mark] = np.array([f"{i}{mark}".encode() for i in range(max(self.width, int(ids.max()) + 1))], object)
        return table[ids]

    def __call__(self, row: list[bytes]) -> tuple[int, int, int, int, str, bytes, bytes]:
        a, b, first, last = (np.frombuffer(x, "<u4").astype(np.int64) for x in row)
        if not len(a):
            return 0, 0, 0, 0, "", b"", b""
        of_a, of_b = groups(a, b, first, last)
        out = np.empty(len(a) + len(b), object)
        for ids, own, inner, outer, shift in ((a, of_a, ",", "|", np.searchsorted(of_b, of_a, "left")), (b, of_b, ",", ";", np.searchsorted(of_a, of_b, "right"))):
            ends = np.ones(len(ids), bool)
            ends[:-1] = own[1:] > own[:-1]
            out[np.arange(len(ids)) + shift] = np.where(ends, self._written(outer, ids), self._written(inner, ids))
        digest = hashlib.sha256(b"".join(out.tolist())[:-1]).hexdigest()
        n = last - first + 1
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        codes, times = np.unique(np.repeat(a, n) * self.width + b[np.repeat(first, n) + inside], return_counts=True)
        return len(a), len(b), int(of_a[-1]) + 1, int(n.sum()), digest, codes.astype("<i8").tobytes(), times.astype("<u4").tobytes()


_SUMMARY = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def summarise(aligned: DataFrame, keys: list[str], width: int) -> DataFrame:
    """For each aligned row: the key columns, numbers of tokens, groups and links, a digest of the groups, and the distinct id pairs with their links.

    A pair is written as ``a * width + b`` (``pairs``, 64-bit), its links as ``times`` (unsigned 32-bit). ``width`` is the number of ids of B. The digest is of
    ``a1,a2|b1;a3|b2,b3`` in decimal ids; without tokens it is the empty string.
    """
    slim = aligned.select(*keys, "a_ids", "b_ids", "first_b", "last_b")
    schema = T.StructType([*slim.schema.fields[:-4], *T._parse_datatype_string(_SUMMARY).fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Summary(width)
        for batch in batches:
            for part in slices(_as_binary(batch), batch.num_columns - 1):
                k = part.num_columns - 4
                rows = [work(list(x)) for x in zip(*(part.column(i).to_pylist() for i in range(k, k + 4)))]
                cols = [pa.array(c, schema_type) for c, schema_type in zip(zip(*rows), (*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *cols], names=names)

    return slim.mapInArrow(run, schema)


def _as_binary(batch: pa.RecordBatch) -> pa.RecordBatch:
    """NULL lists count as empty ones."""
    cols = [pc.fill_null(c, b"") if pa.types.is_binary(c.type) else c for c in batch.columns]
    return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weight = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[heads], np.add.reduceat(weight, heads) if len(heads) else weight


def pair_counts(summaries: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of all id pairs: links in the whole corpus, and whether no other pair with the same id of B has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for pairs, times in zip(batch.column(0), batch.column(1)):
                codes.append(np.frombuffer(pairs.as_buffer() or b"", "<i8"))
                counts.append(np.frombuffer(times.as_buffer() or b"", "<u4").astype(np.int64))
                held += len(codes[-1])
                if held > 2 * GATHER:
                    own, n = _summed(codes, counts)
                    codes, counts, held = [own], [n], len(own)
                    if held > GATHER:
                        yield from _parts(own, n)
                        codes, counts, held = [own[:0]], [n[:0]], 0
        yield from _parts(*_summed(codes, counts))

    def _parts(own: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

    found = summaries.filter("n_links > 0").select("pairs", "times").mapInArrow(run, "pair long, n long")
    counted = found.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % width)
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_count(counts: DataFrame, head_pairs: int) -> int:
    """The least n = 2^k so that pairs counted n times or more are ``head_pairs`` at most."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()  # at most 63 rows
    total, least = 0, 62
    for k, c in sorted(((r.k, r.c) for r in sizes), reverse=True):
        total += c
        if total > head_pairs:
            break
        least = k
    else:
        least = 0
    return 1 << least


def score(summaries: DataFrame, counts: DataFrame, keys: list[str], head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """The summaries with ``n_best`` (links whose pair is the most frequent of its id of B) and ``count_sum`` (over links, the pair's links in the corpus).

    ``summaries`` is stored and has a column ``row`` that tells its rows apart; ``counts`` is stored as well. The ``head_pairs`` most frequent pairs are
    broadcast, rows send their other pairs through a join by pair.
    """
    least = _least_count(counts, head_pairs)
    head = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    table = [np.asarray(head.column(i).to_numpy()) for i in (0, 1, 2)]
    shared = summaries.sparkSession.sparkContext.broadcast(table)
    slim = summaries.select("row", *keys, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    schema = T.StructType([*slim.schema.fields[:-2], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = schema.fieldNames()

    def looked_up(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        own, n, best = shared.value
        for pairs, times in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            codes = np.frombuffer(pairs.as_buffer() or b"", "<i8")
            at = np.minimum(np.searchsorted(own, codes), max(len(own) - 1, 0))
            known = own[at] == codes if len(own) else np.zeros(len(codes), bool)
            yield codes, np.frombuffer(times.as_buffer() or b"", "<u4").astype(np.int64), at, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = shared.value
        for batch in batches:
            sums = [(int((t[k] * best[at[k]]).sum()), int((t[k] * n[at[k]]).sum())) for _, t, at, k in looked_up(batch)]
            cols = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *cols], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (codes, t, _, known) in zip(batch.column(0).to_pylist(), looked_up(batch)):
                if not known.all():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full((~known).sum(), row)), pa.array(codes[~known]), pa.array(t[~known])], names=["row", "pair", "t"])

    scored = slim.mapInArrow(run, schema)
    if least > 1:
        rest = slim.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, t long").join(counts.filter(F.col("n") < least), "pair")
        more = rest.groupBy("row").agg(F.sum(F.col("t") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("t") * F.col("n")).alias("_sum"))
        scored = scored.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return scored.select(*keys, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_scores(docs: DataFrame, a_file: str, b_file: str, width: int, key: str = "doc_id", text: str = "text",
                   head_pairs: int = HEAD_PAIRS) -> tuple[DataFrame, list[str]]:
    """One row for each row of ``docs``: the key and the measures of ``score``; and the scratch paths it reads.

    Rows without tokens (``align``) have zeros and an empty digest. A NULL key is kept as it is.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = summarise(align(slim, a_file, b_file, ["key"]), ["key"], width)
    kept, p_kept = store(rows.withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts, p_counts = store(pair_counts(kept, width), "pair-counts")
    return score(kept, counts, ["key"], head_pairs).withColumnRenamed("key", key), [p_kept, p_counts]


def forget(docs: DataFrame, paths: list[str]) -> None:
    """Delete the scratch tables of ``aligned_scores`` once its rows are written."""
    drop(docs.sparkSession, *paths)
