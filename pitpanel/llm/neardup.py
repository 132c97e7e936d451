"""Near-duplicate documents: MinHash bands, Bayesian pruning of candidates, exact verification, components.

1. Texts with the same set of shingles form a class; only its least id goes on, so copies are never compared.
2. Signatures of classes are cut into bands. Classes that share a band are candidates, found as (bucket, least member).
3. A candidate pair's signatures are compared batch by batch; it is dropped as soon as the posterior probability of the wanted
   similarity falls below ``MISS``. What survives is verified on the full sets.
4. Links become components, bucket by bucket (``buckets.grouped``).
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.buckets import grouped, members_of
from pitpanel.llm.common import Words, drop, mix, mix_window, over_text, store, utf8

#: Words of a shingle, and similarity of a link in hundredths.
SHINGLE, SIMILAR = 5, 80
#: 24 bands of 4 values miss a pair at similarity 0.8 with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Signature values compared before each Bayesian test, and the probability of missing a link that a test may risk.
BATCH, MISS = 16, 1e-6

_SEEDS = np.random.default_rng(20)
_A = _SEEDS.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEEDS.integers(0, 2**63, BANDS * ROWS, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes; shorter texts are one shingle, texts without words none."""
    data, offsets = utf8(texts)
    words = Words(_LOWER[data], offsets)
    hashes = words.hashes()
    grams, bounds = words.grams(hashes, k)
    out = []
    for i in range(len(texts)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if 0 < b - a < k:
            out.append(mix_window(hashes, np.array([a]), int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
    return out


def _sign(texts: pa.Array, k: int) -> list[pa.Array]:
    sets = shingle_sets(texts, k)
    sizes = np.array([len(s) for s in sets])
    full = sizes > 0
    sums, folds = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    signatures = np.zeros((len(sets), len(_A)), "<u4")
    if full.any():
        every = np.concatenate([s for s in sets if len(s)])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        sums[full] = np.add.reduceat(mix(every), starts)
        folds[full] = np.bitwise_xor.reduceat(mix(every + np.uint64(0x9E3779B97F4A7C15)), starts)
        for i, (a, b) in enumerate(zip(_A, _B)):
            signatures[full, i] = np.minimum.reduceat(((every * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return [pa.array(sizes, pa.int64()), pa.array(sums.view(np.int64)), pa.array(folds.view(np.int64)), pa.array([s.tobytes() for s in signatures], pa.binary())]


def least_matches(batch: int, values: int, similar: float, miss: float) -> list[tuple[int, int]]:
    """After n compared values, the fewest matches with which P(similarity >= similar | matches) is still ``miss`` or more.

    The prior is uniform, so the posterior is a beta distribution, and its upper tail is a binomial sum.
    """
    out = []
    for n in range(batch, values + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose signatures leave the wanted similarity possible."""
    own = classes.select("rep", "signature")
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    tests = least_matches(BATCH, len(_A), SIMILAR / 100, MISS)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for n, least in tests:
                matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                ok = matches >= least
                alive, matches, done = alive[ok], matches[ok], n
            yield batch.select([0, 1]).take(pa.array(alive))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def cluster(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE) -> tuple[DataFrame, list[str]]:
    """One row for each row of ``docs``: id, n_shingles, component_id (least id reachable over links), kept (the id is that). And scratch paths.

    Words are lower-cased in A-Z only. A NULL text counts as empty; texts without words, and rows without an id, are linked with
    nothing and kept. Rows that repeat an id are one document: a link of either counts for both. Other columns are not looked at.
    """
    spark = docs.sparkSession
    fields = [T.StructField(n, T.LongType()) for n in ("n_shingles", "fp1", "fp2")] + [T.StructField("signature", T.BinaryType())]
    slim = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text"))
    signed, p_signed = store(over_text(slim, ["rep"], "text", fields, lambda: lambda t: _sign(t, k)), "near-signed")
    classes, p_classes = store(signed.filter("n_shingles > 0 and rep is not null").groupBy("n_shingles", "fp1", "fp2").agg(
        F.min(F.struct("rep", "signature")).alias("m")).select("m.rep", "n_shingles", "fp1", "fp2", "m.signature"), "near-classes")
    members, p_members = store(_members(classes), "near-members")
    texts, p_texts = store(slim.filter("text is not null").join(members.select("rep").distinct(), "rep"), "near-texts")
    roots, p_roots = grouped(members, texts, lambda t: shingle_sets(t, k), SIMILAR, lambda pairs: _prune(pairs, classes))
    labels, p_labels = store(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "fp1", "fp2", F.coalesce("root", "rep").alias("component")), "near-labels")
    drop(spark, p_members, p_texts, p_classes, *p_roots)
    out = signed.select("rep", "n_shingles", "fp1", "fp2").join(labels, ["n_shingles", "fp1", "fp2"], "left")
    component = F.when(F.col("rep").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep"))
    rows = out.select(F.col("rep").alias(id_col), "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), [p_signed, p_labels]


def _members(classes: DataFrame) -> DataFrame:
    """(key, rep, lead) of every class in a bucket that holds others; lead is the bucket's least class."""
    step = 4 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keyed = classes.select("rep", "signature", band.alias("band")).select(
        F.xxhash64("band", F.expr(f"substring(signature, band * {step} + 1, {step})")).alias("key"), "rep")
    return members_of(keyed).distinct()
