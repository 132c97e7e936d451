"""From buckets of candidates to connected groups, without ever pairing up a bucket.

Round one tests each member against the least member of its buckets. A bucket whose members then form one component is settled: no
other pair in it could change anything. Where verifying is cheap, members outside a bucket's largest component are tested against a few
of that component next, and small buckets are finished pair by pair. Members of all other buckets are joined on their rarest shingles, which finds every pair of the
wanted similarity: a pair's first common shingle, rarest first, stands early in both sets and nearest to the front in the smaller one
(the prefix and position filters of set joins). Only pairs across components are formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.common import drop, slices, store
from pitpanel.llm.components import connected

#: Members of a bucket's largest component that each of its other members is tested against in round two.
PARTNERS = 4
#: Pairs of one member that are verified by one task.
PAIRS_A_TASK = 2_000

Sets = Callable[[pa.Array], list[np.ndarray]]


def members_of(keyed: DataFrame) -> DataFrame:
    """(key, rep, lead) of the rows (key, rep) whose key others share; lead is the least of them."""
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").drop("last")
    return keyed.join(buckets, "key").select("key", "rep", "lead")


def grouped(members: DataFrame, texts: DataFrame, sets: Sets, similar: int, prune: Callable[[DataFrame], DataFrame] | None = None,
            pairs_a_bucket: int = 0) -> tuple[DataFrame, list[str]]:
    """(node, root) for every member that is linked to another, and the scratch paths behind it.

    ``members`` has (key, rep, lead), ``texts`` (rep, text) for all of them; both are stored. ``sets`` gives the shingles of texts; a link
    takes ``similar`` hundredths of their union. ``prune`` may drop candidate pairs (a, b) before they are verified. With ``pairs_a_bucket`` round two is
    done, and what is left of a bucket is paired up if that takes so many pairs at most; it changes the cost, not the result.
    """
    spark = members.sparkSession
    scratch: list[str] = []

    def links(pairs: DataFrame) -> DataFrame:
        candidates, p = store(prune(pairs) if prune else pairs, "candidates")
        found, q = store(verified(candidates, texts, sets, similar), "links")
        scratch.extend([p, q])
        return found

    found = links(members.filter("lead < rep").groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("a")).select("a", "b"))
    roots, p_roots = connected(found)
    labelled, p = store(members.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("comp")), "buckets")
    scratch.append(p)
    if pairs_a_bucket:
        found = found.unionByName(links(_stray_pairs(labelled, PARTNERS)))
        drop(spark, *p_roots)
        roots, p_roots = connected(found)
        labelled, p = store(labelled.drop("comp").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", F.coalesce("root", "rep").alias("comp")), "buckets")
        scratch.append(p)
    mixed, p = store(_mixed(labelled).select("key", (F.col("n") * (F.col("n") - F.col("most"))).alias("pairs")), "mixed")
    scratch.append(p)
    if pairs_a_bucket:
        found = found.unionByName(links(_stray_pairs(labelled.join(mixed.filter(F.col("pairs") <= pairs_a_bucket).select("key"), "key"))))
    open_, p = store(labelled.join(mixed.filter(F.col("pairs") > pairs_a_bucket).select("key"), "key").select("rep", "comp").distinct(), "unsettled")
    scratch.append(p)
    found = found.unionByName(links(_rare_pairs(open_, texts, sets, similar)))
    drop(spark, *p_roots)
    roots, p_roots = connected(found)
    drop(spark, *scratch)
    return roots, p_roots


def _mixed(members: DataFrame) -> DataFrame:
    """(key, n, most, largest): size, and size and name of the largest component, of every key with several components."""
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    return whole.filter("comps > 1").select("key", "n", F.col("m.n").alias("most"), F.col("m.comp").alias("largest"))


def _stray_pairs(members: DataFrame, partners: int = 0) -> DataFrame:
    """Within each key, members outside the largest component against the members of other components, or against
    that many of the largest one, chosen by hash. members: key, rep, comp."""
    inside = members.join(_mixed(members).select("key", "largest"), "key")
    strays = inside.filter("comp <> largest").select("key", F.col("rep").alias("x"), F.col("comp").alias("cx"))
    others = inside.select("key", "rep", "comp")
    if partners:
        picks = [F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(k))) for k in range(partners)]
        others = inside.filter("comp = largest").groupBy("key").agg(F.array(*picks).alias("picks")).select("key", F.inline("picks"))
    met = strays.join(others, "key").filter("cx <> comp")
    return met.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, similar: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets. A task streams the partners of a, having read a once."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    rows = heads.join(texts, heads.a == texts.rep).select("a", "salt", F.lit(0).alias("kind"), F.col("rep").alias("b"), "text").unionByName(
        salted.join(texts, salted.b == texts.rep).select("a", "salt", F.lit(1).alias("kind"), "b", "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches):
        key, heads_ = None, []
        for batch in batches:
            for part in slices(batch, 4):
                hits = []
                for i, (a, kind, own) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets(part.column(4)))):
                    if kind == 0:
                        heads_ = [*(heads_ if key == a else []), own]  # several only where texts share an id
                        key = a
                    elif key == a and any(similar_sets(h, own, similar) for h in heads_):
                        hits.append(i)
                yield part.select([0, 3]).take(pa.array(hits, pa.int64()))

    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def similar_sets(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    both = len(np.intersect1d(x, y, True))
    return 100 * both >= similar * (len(x) + len(y) - both)


def _rare_pairs(members: DataFrame, texts: DataFrame, sets: Sets, similar: int) -> DataFrame:
    """Pairs across components that share an early shingle, as every similar pair does. members: rep, comp.

    Within a shingle, members outside its largest component meet the others, so those of a large component do not meet each other.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                own = sets(part.column(1))
                sizes = [len(s) for s in own]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(own)), sizes))),
                                                  pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(own).view(np.int64))], names=["rep", "n", "shingle"])

    some = texts.join(members.select("rep"), "rep", "left_semi").select("rep", "text")
    shingles = some.mapInArrow(run, T.StructType([some.schema["rep"], *T._parse_datatype_string("n long, shingle long").fields]))
    counted = shingles.join(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")), "shingle")
    ranked = counted.withColumn("at", F.expr("row_number() over (partition by rep order by docs, shingle)")).filter("docs > 1")
    early = F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * similar / (100 + similar)) + 1
    prefix = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similar / 100) + 1).withColumn("early", early).join(members, "rep")
    shares = prefix.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("early").alias("early"))
    useful = shares.groupBy("shingle").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"), F.count(F.lit(1)).alias("comps"),
                                           F.max("early").alias("any_early")).filter("comps > 1 and any_early").select("shingle", "largest")
    inside = prefix.join(useful, "shingle").select("shingle", "rep", "comp", "n", "at", "early", "largest")
    x = inside.filter("comp <> largest").select("shingle", *(F.col(c).alias("x_" + c) for c in ("rep", "comp", "n", "at", "early")))
    left_over = F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) + 1
    fits = (F.col("comp") != F.col("x_comp")) & ((F.col("early") & (F.col("n") <= F.col("x_n"))) | (F.col("x_early") & (F.col("x_n") <= F.col("n")))) & (
        left_over * (100 + similar) >= similar * (F.col("n") + F.col("x_n")))
    met = x.join(inside.drop("largest"), "shingle").filter(fits)
    return met.select(F.least("x_rep", "rep").alias("a"), F.greatest("x_rep", "rep").alias("b")).distinct()
