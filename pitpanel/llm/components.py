"""Connected components of a graph of any size: a union-find of alternating large and small stars.

In a large star every node hands the neighbours above it to its least neighbour; in a small star the neighbours at or below
it. Edges shrink to (node, root) stars in about log(n) rounds. Each round is stored, so lineage stays short and a lost executor
costs one round. A node with very many neighbours is only ever a join key with stored rows on both sides, which
Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import drop, store


def connected(edges: DataFrame, name: str = "components") -> tuple[DataFrame, list[str]]:
    """(node, root) for every node with an edge, roots included; the root is the least node. And the scratch paths behind it.

    ``edges`` has columns a and b of one orderable type. NULLs, loops and repeated edges are allowed and change nothing.
    """
    spark = edges.sparkSession
    start = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    stars, path = store(start.distinct(), name)
    while not _flat(stars):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least, p1 = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large, p2 = store(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), name)
        least, p3 = store(large.groupBy("hi").agg(F.min("lo").alias("m")), name)
        moved = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars, p4 = store(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), name)
        drop(spark, path, p1, p2, p3)
        path = p4
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots), [path]


def _flat(stars: DataFrame) -> bool:
    """Whether every upper node has one lower node, and no lower node is an upper one: then the lower ones are the roots."""
    ends = stars.select(F.col("hi").alias("node"), F.lit(1).alias("upper"), F.lit(0).alias("lower")).unionByName(
        stars.select(F.col("lo").alias("node"), F.lit(0).alias("upper"), F.lit(1).alias("lower")))
    return ends.groupBy("node").agg(F.sum("upper").alias("upper"), F.max("lower").alias("lower")).filter("upper + lower > 1 and upper > 0").isEmpty()
