"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found in bidirectional FM-indexes of the vocabulary.

One error lies in one half of a word, so the other half is the same in both. The vocabulary is dealt to shards twice, by the left half
of each word and by its right half; each word asks the shards where words that share one of its halves lie. A shard indexes its words, each between
delimiters, forwards and backwards. A search matches the common half exactly by extending to the delimiter, keeping the suffix-rank intervals of both
directions, and then extends across the other half with one error: at each code point the interval goes on exactly, or skips it, or
branches into the code points that really follow. Intervals that become empty are dropped, and whoever reaches the other delimiter is a word.
All searches of a shard advance together.

Halves that more than ``BLOCK`` words share are hot: their words are dealt to blocks of that size and their searches to salts, so
no task indexes or asks more than a bounded number of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import drop, slices, store

# What a run of letters is, the share of damaged runs, the least length and count of a word, and how much more often its form occurs.
DAMAGED, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5

#: Words of a shard, about; words with one half that a block holds, and that ask together.
SHARD, BLOCK = 10_000, 20_000
#: Counters of a task are handed on when they hold so many words.
GATHER = 500_000
#: A maximal run that can still be a word: one shorter than ``LEAST_LENGTH`` is none, damaged or not.
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Searches of one length that advance together.
TOGETHER = 2_000
_WINDOW = 64  # bits of a number
_ABOVE = np.array([(1 << k) - 1 for k in range(_WINDOW)], np.uint64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): how often each word of ``LEAST_LENGTH`` code points or more occurs in all texts, damaged runs as they are damaged.

    A NULL text has no words. A NULL id counts as the empty string. Rows that repeat count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, 1):
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    name = crc32(f"{'' if doc is None else doc}:".encode())  # carried on for each word
                    # bytes.lower() changes A-Z only
                    for word, n in Counter(RUN.findall(body.encode().lower().decode())).items():
                        h = crc32(word.encode(), name)
                        if h % DAMAGED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        found[word] += n
                if len(found) > GATHER:
                    yield _table(found)
                    found.clear()
        if found:
            yield _table(found)

    def _table(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    slim = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("d"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Direction:
    """The FM-index of words written one way, each between delimiters: suffix ranks, their preceding symbols, and ranks of symbols.

    Words are sorted, so suffixes that agree up to their delimiter stand in the order of their words.
    """

    def __init__(self, words: list[np.ndarray], symbols: int):
        order = sorted(range(len(words)), key=lambda i: words[i].tolist())
        self.words = np.array(order, np.int64)  # k-th word in order -> its number
        lengths = np.array([len(words[i]) for i in order], np.int64)
        text = np.zeros(int(lengths.sum()) + len(order) + 1, words[0].dtype)  # 0 is the delimiter, at the front and behind each word
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + 1
        flat = np.concatenate([words[i] for i in order])
        text[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(flat))] = flat
        n = len(text)
        # rank suffixes by what precedes their delimiter, doubling the compared length; those that agree stay in the order of the text
        rank = text.astype(np.int64)
        ends = np.flatnonzero(text == 0)
        to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols up to the delimiter
        span, longest = 1, int(to_end.max(initial=0))
        while span < longest:
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(to_end >= span)
            after[inside] = rank[inside + span]
            key = rank * (n + symbols + 1) + after
            sort = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[sort][1:] != key[sort][:-1])]) + 1
            rank[sort] = fresh
            rank[text == 0] = 0
            span *= 2
        suffixes = np.argsort(rank, kind="stable")
        self.bwt = text[suffixes - 1]
        self.n = n
        hits = np.bincount(text, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(hits)])  # where suffixes with each symbol begin
        blocks = n // _WINDOW + 1
        wide = np.full(blocks * _WINDOW, np.iinfo(text.dtype).max, text.dtype)
        wide[:n] = self.bwt
        self.windows = wide.reshape(blocks, _WINDOW)
        per = np.bincount(np.repeat(np.arange(blocks), _WINDOW)[:n] * symbols + self.bwt, minlength=blocks * symbols).reshape(blocks, symbols)
        below = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(per, axis=1)], axis=1)  # symbols less than each, per block
        self.below = np.concatenate([np.zeros((1, symbols + 1), np.int64), np.cumsum(below, axis=0)[:-1]]).astype(np.int32)

    def _marked(self, hits: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of a window's symbols that are marked stand above the row."""
        bits = np.packbits(hits, axis=1, bitorder="little").view("<u8")[:, 0]
        return np.bitwise_count(bits & _ABOVE[row % _WINDOW]).astype(np.int64)

    def same(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the preceding symbols above each row equal the symbol."""
        block = row // _WINDOW
        return self.below[block, symbol + 1] - self.below[block, symbol] + self._marked(self.windows[block] == symbol.astype(self.bwt.dtype)[:, None], row)

    def fewer(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the preceding symbols above each row are less than the symbol."""
        block = row // _WINDOW
        return self.below[block, symbol] + self._marked(self.windows[block] < symbol.astype(self.bwt.dtype)[:, None], row)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval with one more symbol in front."""
        return self.first[symbol] + self.same(symbol, low), self.first[symbol] + self.same(symbol, high)

    def shift(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """By how much the interval of the other direction moves up when this one is extended."""
        return self.fewer(symbol, high) - self.fewer(symbol, low)

    def followers(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) for every symbol but the delimiter that stands before a suffix of each interval."""
        symbols = len(self.first) - 1
        width = high - low
        narrow, wide = np.flatnonzero(width <= symbols), np.flatnonzero(width > symbols)
        n = width[narrow]
        state = np.repeat(narrow, n)
        symbol = self.bwt[np.repeat(low[narrow], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        key = np.unique(np.concatenate([state * symbols + symbol, np.repeat(wide * symbols, symbols) + np.tile(np.arange(symbols), len(wide))]))
        key = key[key % symbols > 0]
        return key // symbols, key % symbols


class Index:
    """Words of a shard, indexed in both directions over their own alphabet."""

    def __init__(self, words: list[str]):
        self.words = words  # one at least
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.alphabet = np.unique(np.concatenate(points))
        self.symbols = len(self.alphabet) + 1
        size = np.uint8 if self.symbols < 255 else np.int32
        coded = [(np.searchsorted(self.alphabet, p) + 1).astype(size) for p in points]
        self.forward = Direction(coded, self.symbols)
        self.backward = Direction([c[::-1] for c in coded], self.symbols)

    def code(self, word: str) -> np.ndarray:
        """The symbols of a word; -1 where no word of the index has that code point."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1).astype(np.int64)

    def near(self, queries: list[str], left: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) for words one error away, the error not in the left (else right) half of the query: halves one shorter than (length / 2), rounded up."""
        by_length: dict[int, list[int]] = {}
        for q, word in enumerate(queries):
            by_length.setdefault(len(word), []).append(q)
        for length, some in by_length.items():
            for k in range(0, len(some), TOGETHER):
                part = some[k : k + TOGETHER]
                codes = np.array([self.code(queries[q]) for q in part], np.int64)
                yield from self._near(np.array(part, np.int64), codes if left else codes[:, ::-1], left)

    def _near(self, names: np.ndarray, codes: np.ndarray, left: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # towards the common end first, then away from it; for right halves both words and roles are mirrored
        inner, outer = (self.forward, self.backward) if left else (self.backward, self.forward)
        half, length = (codes.shape[1] - 1) // 2, codes.shape[1]
        q = np.flatnonzero((codes[:, :half] >= 0).all(axis=1))
        low, high, low2 = (np.zeros(len(q), np.int64) for _ in range(3))
        high[:] = inner.n
        for symbol in [*(codes[:, t] for t in range(half - 1, -1, -1)), np.zeros(len(codes), np.int64)]:
            low2 = low2 + inner.shift(symbol[q], low, high)
            low, high = inner.extend(symbol[q], low, high)
            some = low < high
            q, low, high, low2 = q[some], low[some], high[some], low2[some]
        # only the other direction's interval is needed from here on
        low, high = low2, low2 + (high - low)
        exact = (q, low, high)
        wrong = none = tuple(np.zeros(0, np.int64) for _ in range(3))
        for t in range(half, length + 1):
            q, low, high = exact
            fresh = []
            if len(q):
                state, symbol = outer.followers(low, high)
                own = codes[q[state], t] if t < length else np.zeros(len(state), np.int64)
                differs = symbol != own
                state, symbol = state[differs], symbol[differs]
                a, b = outer.extend(symbol, low[state], high[state])
                inserted = (q[state], a, b)  # the word has one more code point here
                replaced = inserted if t < length else none
                skipped = exact if t < length else none  # the word lacks this one
            else:
                inserted, replaced, skipped = none, none, none
            # states with an error that wait for code point t: those carried on, and the inserted ones of this step
            waiting = _joined(wrong, inserted)
            if t < length:
                wrong = _joined(self._exactly(outer, codes[:, t], *waiting), replaced, skipped)
                exact = self._exactly(outer, codes[:, t], *exact)
            else:
                wrong = waiting
        q, low, high = self._exactly(outer, np.zeros(len(codes), np.int64), *wrong)
        # a suffix that begins with a delimiter names the word behind it: rows of delimiters stand in the order of their words
        n = high - low
        row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word = outer.words[row - 1] if len(row) else row
        pair = np.unique(np.repeat(names[q], n) * (len(self.words) + 1) + word) if len(row) else row
        yield pair // (len(self.words) + 1), pair % (len(self.words) + 1)

    @staticmethod
    def _exactly(index: Direction, symbol: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        known = symbol[q] >= 0
        q, low, high = q[known], low[known], high[known]
        low, high = index.extend(symbol[q], low, high)
        some = low < high
        return q[some], low[some], high[some]


def _joined(*states: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*states))


def _halves(word_length: int) -> tuple[int, int]:
    """Code points of the left and the right half of a word."""
    return word_length // 2, word_length - word_length // 2


def _shard_pairs(rows: pa.Table) -> pa.Table:
    """Near words within one shard: word, how many, and the best of them (n, word)."""
    words, kinds, roles, ns = (rows.column(c).to_pylist() for c in ("word", "kind", "role", "n"))
    left = kinds[0] == 0
    own = [i for i, r in enumerate(roles) if r == 0]
    asking = [i for i, r in enumerate(roles) if r == 1]
    out: dict[int, tuple[int, int, str]] = {}
    if own and asking:
        index = Index([words[i] for i in own])
        for queries, hits in index.near([words[i] for i in asking], left):
            for k, h in zip(queries.tolist(), hits.tolist()):
                i, j = asking[k], own[h]
                u, v = words[i], words[j]
                a, b = _halves(len(v))
                same_left = u[:a] == v[:a]
                if (left and not same_left) or (not left and (same_left or u[-b:] != v[-b:])):
                    continue  # the other half finds this pair
                near, n, best = out.get(i, (0, -1, ""))
                if ns[j] > n or (ns[j] == n and v < best):
                    n, best = ns[j], v
                out[i] = (near + 1, n, best)
    found = list(out.items())
    return pa.table({"word": pa.array([words[i] for i, _ in found], pa.string()), "near": pa.array([x[0] for _, x in found], pa.int64()),
                     "form_n": pa.array([x[1] for _, x in found], pa.int64()), "form": pa.array([x[2] for _, x in found], pa.string())})


def _dealt(vocabulary: DataFrame, shards: int, block: int) -> DataFrame:
    """Words with the shards they are indexed in (role 0) and the shards they ask (role 1)."""
    n = F.length("word")
    left, right = (n / 2).cast("int"), n - (n / 2).cast("int")

    def key(kind: int, size) -> object:
        half = F.col("word").substr(F.lit(1), size) if kind == 0 else F.col("word").substr(n - size + 1, size)
        return F.struct(F.lit(kind).alias("kind"), half.alias("half"))

    def halves(length, kind: int):
        return (length / 2).cast("int") if kind == 0 else length - (length / 2).cast("int")

    indexed = vocabulary.select("word", "n", F.lit(0).alias("role"), F.explode(F.array(key(0, left), key(1, right))).alias("k"))
    asked = F.array_distinct(F.array(*(key(kind, halves(n + d, kind)) for kind in (0, 1) for d in (-1, 0, 1))))
    asking = vocabulary.select("word", "n", F.lit(1).alias("role"), F.explode(asked).alias("k"))
    sizes = indexed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block)
    hot = sizes.select("k", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    rows = indexed.unionByName(asking).join(hot, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.when(F.col("role") == 0, F.transform(every, lambda s: F.struct(own.alias("block"), s.alias("salt")))).otherwise(
        F.transform(every, lambda b: F.struct(b.alias("block"), own.alias("salt"))))
    spread = rows.withColumn("cell", F.explode(cells))
    cold = F.pmod(F.xxhash64("k"), F.lit(shards))
    place = F.when(F.col("blocks") == 1, F.struct(F.col("k.kind").alias("kind"), cold.alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("c"))).otherwise(
        F.struct(F.col("k.kind").alias("kind"), F.xxhash64("k").alias("a"), F.col("cell.block").alias("b"), F.col("cell.salt").alias("c")))
    return spread.select(place.alias("shard"), F.col("k.kind").alias("kind"), "role", "word", "n").distinct()


def group_variants(counts: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """One row for each word of (word, n) with n >= ``least_count``: form, root, n, n_near and form_n; and the scratch paths it reads.

    ``form`` is the near word of largest n (ties: the least in code-point order), if that n is ``times`` the word's own or more, else NULL; ``root`` is the end
    of the chain of forms, the word itself without one. Words of fewer than ``LEAST_LENGTH`` code points are not looked for. No words give no rows.
    """
    spark = counts.sparkSession
    vocabulary, p_words = store(counts.filter((F.col("n") >= least_count) & (F.length("word") >= LEAST_LENGTH)).select("word", "n"), "vocabulary")
    size, top = vocabulary.agg(F.count(F.lit(1)), F.max("n")).first()
    shards = max(1, -(-size // shard))
    pairs, p_pairs = store(_dealt(vocabulary, shards, block).groupBy("shard").applyInArrow(
        _shard_pairs, "word string, near long, form_n long, form string"), "variant-pairs")
    most = F.max("form_n").over(Window.partitionBy("word"))
    best = pairs.withColumn("most", most).groupBy("word").agg(F.sum("near").alias("n_near"), F.max("form_n").alias("form_n"),
                                                             F.min(F.when(F.col("form_n") == F.col("most"), F.col("form"))).alias("form"))
    joined = vocabulary.join(best, "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    formed, p_formed = store(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"),
                                           F.when(good, F.col("form_n")).alias("form_n")), "variant-forms")
    # counts grow by a factor with every form, so chains are short; each round doubles the steps taken
    steps, reach = 1, least_count * times
    while top is not None and reach < top and times > 1:
        steps, reach = steps + 1, reach * times
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    scratch = [p_formed]
    for _ in range(max(0, (steps - 1).bit_length())):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots, p = store(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
        scratch.append(p)
    drop(spark, p_words, p_pairs)
    out = formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return out, scratch
