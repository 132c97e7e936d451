"""Byte-level BPE: texts to token ids and back, with the ranks of a public vocabulary.

``encode`` splits each whole text by the pattern, and merges the distinct pieces of a slice of texts together.
Pieces of similar length share one padded matrix of token ids; in each round every row of a matrix merges its
leftmost pair of minimum rank, the row closes the gap, and rows without a mergeable pair leave the matrix. Ranks
of pairs come from a hash table over (left id, right id). Pieces longer than ``WIDEST`` bytes go through a heap
of pairs instead, which merges in the same order without a matrix of that width.

A piece that is a token itself becomes that token, and no special tokens are made, as the common libraries do.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitpanel.llm.common import SLICE_BYTES, over_text

#: Bytes of the widest matrix row; longer pieces go through the heap.
WIDEST = 512
#: Pieces kept with their ids between slices of texts.
CACHE_PIECES = 100_000
_NONE = np.int32(2**31 - 1)
_ROWS = 4096


class Tokens:
    """The vocabulary of a rank file as token bytes."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, in order."""
        parts = []
        for k in range(0, len(ids), CACHE_PIECES):
            some = ids[k : k + CACHE_PIECES]
            n = self.lengths[some]
            start = np.repeat(self.offsets[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            parts.append(self.flat[start + np.arange(len(start))].tobytes())
        return b"".join(parts)


class Merges(Tokens):
    """Also a hash table of the pairs that merge."""

    def __init__(self, rank_file: bytes):
        super().__init__(rank_file)
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get, keys, values = self.ranks.get, array("Q"), array("i")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._fill(np.frombuffer(keys, np.uint64), np.frombuffer(values, np.int32))

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The table as a dictionary, for the heap."""
        used = self.values != _NONE
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist()))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, _NONE)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            tries = left[free]
            _, first = np.unique(at[tries], return_index=True)
            won = tries[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest int32 where a pair does not merge. Ids below 0 are padding."""
        out = np.full(left.shape, _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[open_].astype(np.uint64) << np.uint64(32) | right.ravel()[open_].astype(np.uint64)
        at, flat = self._slot(key), out.ravel()
        while len(open_):
            there = self.keys[at]
            hit = there == key
            flat[open_[hit]] = self.values[at[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            open_, key, at = open_[go], key[go], (at[go] + 1) & self.mask
        return flat.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > WIDEST:
                out[i] = self._by_heap(piece)
            elif piece:
                by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(64, _ROWS * 16 // width)
            for k in range(0, len(rows), step):
                self._by_matrix(pieces, rows[k : k + step], width, out)
        return out

    def _by_matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        own = np.array(rows)
        lengths = np.array([len(pieces[i]) for i in rows])
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[data], np.int32(-1)).astype(np.int32)
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(own):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            done = best == _NONE
            if done.any():
                for i, row, n in zip(own[done], ids[done].astype("<u4"), lengths[done]):
                    out[i] = row[:n].tobytes()
                go = ~done
                own, ids, ranks, at, best, lengths = own[go], ids[go], ranks[go], at[go], best[go], lengths[go]
                if not len(own):
                    return
            here = np.arange(len(own))
            lengths = lengths - 1
            width = max(int(lengths.max()), 2)
            column = np.arange(width)
            ids[here, at] = best
            wide = np.concatenate([ids, np.full((len(own), 1), -1, np.int32)], axis=1)
            ids = np.take_along_axis(wide, column + (column > at[:, None]), axis=1)
            wide = np.concatenate([ranks, np.full((len(own), 2), _NONE, np.int32)], axis=1)
            ranks = np.take_along_axis(wide, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            right = at < width - 1
            ranks[here[right], at[right]] = self.rank_of(ids[here[right], at[right]], ids[here[right], at[right] + 1])
            left = at > 0
            ranks[here[left], at[left] - 1] = self.rank_of(ids[here[left], at[left] - 1], ids[here[left], at[left]])

    def _by_heap(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j], k = rank, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (p := before[i]) >= 0 and (r := pairs.get(ids[p] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


_BUILT: dict[int, tuple[Merges, dict[str, bytes]]] = {}


def _merges(rank_file: bytes) -> tuple[Merges, dict[str, bytes]]:
    """The tables and the cache of pieces, built once a worker."""
    key = hash(rank_file)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (Merges(rank_file), {})
    return _BUILT[key]


def _encoder(rank_file: bytes, pattern: str) -> Callable[[pa.Array], list[pa.Array]]:
    merges, cache = _merges(rank_file)
    split = regex.compile(pattern)

    def learn(pieces: set[str]) -> None:
        new = list(pieces.difference(cache))
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = list(pieces)
        cache.update(zip(new, merges.encode_pieces([x.encode() for x in new])))

    def long_text(text: str) -> bytes:  # never all pieces of a very long text at once
        found, parts = split.finditer(text), []
        while some := [m.group() for m in islice(found, CACHE_PIECES // 2)]:
            learn(set(some))
            parts.append(b"".join(map(cache.__getitem__, some)))
        return b"".join(parts)

    def work(texts: pa.Array) -> list[pa.Array]:
        every = texts.to_pylist()
        pieces = [split.findall(x) if len(x) <= SLICE_BYTES else None for x in every]
        learn(set().union(*(x for x in pieces if x)))
        out = [b"".join(map(cache.__getitem__, x)) if x is not None else None for x in pieces]
        out = [long_text(x) if y is None else y for x, y in zip(every, out)]
        return [pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())]

    return work


def encode(docs: DataFrame, vocabulary: str, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """Token ids of every whole text: the key columns, ``n_tokens`` and ``ids``.

    ``ids`` holds little-endian unsigned 32-bit integers. ``vocabulary`` is the path of a rank file that the driver
    can read (under 2 MB; it is broadcast). NULL and empty texts have no tokens; rows that repeat are encoded each; other
    columns of ``docs`` are not looked at.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return over_text(docs, keys, text, fields, lambda: _encoder(ranks.value, pattern))


def decode(tokens: DataFrame, vocabulary: str, keys: list[str], carry: list[str]) -> DataFrame:
    """Bytes of every row of ``ids``: the key and carried columns and ``decoded``. NULL ids decode to no bytes."""
    with open(vocabulary, "rb") as f:
        ranks = tokens.sparkSession.sparkContext.broadcast(f.read())
    slim = tokens.select(*keys, *carry, "ids")
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])
    names = schema.fieldNames()

    def run(batches):
        tokens = Tokens(ranks.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [tokens.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.binary())], names=names)

    return slim.mapInArrow(run, schema)
