"""What several of these operators share: scratch tables, text batches, hashes of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Work inside one task goes on in slices of about this many bytes of text; a longer text is a slice alone.
SLICE_BYTES = 1_000_000


def store(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write rows to the shared folder and read them back; also the path, for ``drop``.

    The files outlive executors, and the shuffle files behind them are released when the write ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def over_text(df: DataFrame, keys: list[str], text: str, fields: list[T.StructField],
              make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """One row out for each row in: the key columns and what ``make()`` computes from the texts.

    ``make`` is called once a task. A NULL text reaches it as the empty string. Texts arrive in slices of
    about ``SLICE_BYTES``. If the text is a key itself, it comes last among the keys, as it was.
    """
    others = [k for k in keys if k != text]
    slim = df.select(*others, text)
    schema = T.StructType([*slim.schema.fields[: len(others) + (text in keys)], *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                cols = work(pc.fill_null(part.column(part.num_columns - 1), ""))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols] if text in keys else [*part.columns[:-1], *cols], names=names)

    return slim.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the bytes of its text column."""
    n = batch.num_rows
    if not n:
        return
    offsets = np.frombuffer(batch.column(text).buffers()[1], np.int32, n + 1, batch.column(text).offset * 4)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + size, "right")) - 1)
        end = min(end, n)
        yield batch.slice(start, end - start)
        start = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 offsets of the texts in them."""
    n, bufs = len(texts), texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# What separates words (space, tab, line feed, vertical tab, form feed, carriage return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SEPARATORS)] = False


class Words:
    """Words of several texts: where they start and end in the bytes, and which belong to which text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _IN_WORD[data]
        n = len(data)
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[offsets] = False  # a text starts: nothing goes before it
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[offsets] = False  # a text ends: nothing follows
        self.data = data
        self.starts = np.flatnonzero(inside & ~before[:n])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # text k has words bounds[k] .. bounds[k + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        power, inverse = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, and the bounds of each text in them."""
        counts = np.maximum(np.diff(self.bounds) - (k - 1), 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = np.repeat(self.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
        return mix_window(hashes, first, k), bounds


def mix_window(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(len(first), np.uint64)
    for j in range(k):
        total = total * _STEP + hashes[first + j]
    return mix(total)


_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TABLES: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, at least n of each."""
    if len(_TABLES.get("p", ())) < n + 1:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("p", _PRIME), ("i", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps)
    p, i = _TABLES["p"], _TABLES["i"]
    if len(p) > 1 << 23:  # a very long text: give the memory back afterwards
        _TABLES.clear()
    return p, i


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))  # from here on a new array, changed in place
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x
