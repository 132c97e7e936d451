"""Exact order statistics inside groups of any size.

A whole cross-section (all companies on one date) may be a large share of the table, so a plain
``Window.partitionBy(date)`` would sort it in one task. Here each group is first cut into ordered
buckets along a small random sample of its own sort keys; every bucket is sorted by its own task
and shifted by the size of the buckets before it. Results are exact and deterministic.

Two side tables have at most ``groups x BUCKETS`` rows. Groups are dates, folds, runs or features, so
these tables do not grow with the rows; the number of groups is counted, and beyond
``FEW_GROUPS`` the side tables are joined by shuffle instead of broadcast. Pass ``buckets=1`` for
groups that the calendar bounds (bars or quarters of one symbol).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import materialise

BUCKETS = 64
FEW_GROUPS = 10_000
_BUCKET, _BOUNDS = "__bucket", "__bounds"


def _key(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _search(bounds: Column, key: Column, buckets: int) -> Column:
    """How many sorted bounds are at or below the key (binary search)."""
    steps = [1 << i for i in range(int(math.log2(buckets)), -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at),
    )


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL: a NULL group is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def few_groups(df: DataFrame, group: list[str]) -> bool:
    """Whether ``groups x BUCKETS`` rows are safe to broadcast. Reads the group columns only."""
    return not group or df.select(*group).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def spread(df: DataFrame, group: list[str], order: list[str], buckets: int = BUCKETS,
           small: bool | None = None) -> DataFrame:
    """Add ``__bucket``: rises with the order inside each group and holds about n/buckets rows.

    The sample is one row per hash stratum, the one with the least hash, so it is bounded,
    reproducible and needs no pass through the driver.
    """
    if buckets <= 1:
        return df.withColumn(_BUCKET, F.lit(0))
    side = F.broadcast if (few_groups(df, group) if small is None else small) else (lambda x: x)
    mark = F.xxhash64(*group, *order)
    sample = df.groupBy(*group, F.pmod(mark, F.lit(buckets)).alias("__stratum")).agg(
        F.min_by(_key(order), mark).alias("__key"))
    if group:
        bounds = sample.groupBy(*group).agg(F.sort_array(F.collect_list("__key")).alias(_BOUNDS))
        joined = join_groups(df, side(bounds), group)
    else:
        bounds = sample.agg(F.sort_array(F.collect_list("__key")).alias(_BOUNDS))
        joined = df.withColumn("__one", F.lit(1)).join(
            F.broadcast(bounds.withColumn("__one", F.lit(1))), "__one").drop("__one")
    return joined.withColumn(_BUCKET, _search(F.col(_BOUNDS), _key(order), buckets)).drop(_BOUNDS)


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    sums: dict[str, Column],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Inclusive running sums ``name`` and group totals ``name_total`` along a total order."""
    names = list(sums)
    if buckets <= 1:
        part = Window.partitionBy(*group)
        run = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(c).over(run).alias(n) for n, c in sums.items()],
            *[F.sum(c).over(part).alias(f"{n}_total") for n, c in sums.items()],
        )
    # Three passes follow (sample, bucket sizes, rows), so the input is written once.
    df = materialise(df, "ordered")
    small = few_groups(df, group)
    cut = spread(df, group, order, buckets, small)
    sizes = cut.groupBy(*group, _BUCKET).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = part.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # At most `buckets` + 1 rows per group from here on.
    offsets = sizes.select(
        *group, _BUCKET,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names],
        *[F.sum(f"__s_{n}").over(part).alias(f"{n}_total") for n in names],
    )
    inner = Window.partitionBy(*group, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_groups(cut, F.broadcast(offsets) if small else offsets, [*group, _BUCKET])
    keep = df.columns
    return out.select(
        *keep,
        *[(F.col(f"__b_{n}") + F.sum(c).over(inner)).alias(n) for n, c in sums.items()],
        *[f"{n}_total" for n in names],
    )


def positions(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str = "position",
    size: str = "group_size",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Row number from 1 along a total order, and the number of rows of the group."""
    ranked = running(df, group, order, {out: F.lit(1).cast("bigint")}, buckets)
    return ranked.withColumnRenamed(f"{out}_total", size)


def quantiles(
    df: DataFrame,
    group: list[str],
    value: str,
    probs: dict[str, float],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; NULLs are ignored.

    Equal values are counted before any ordering; a ``__weight`` column, if present, says how often
    a row counts.
    """
    weight = F.sum("__weight") if "__weight" in df.columns else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(weight.alias("__c"))
    ranked = running(counts, group, [value], {"__end": F.col("__c")}, buckets)
    start, n = F.col("__end") - F.col("__c"), F.col("__end_total")

    def at(index: Column) -> Column:
        return F.max(F.when((start <= index) & (index < F.col("__end")), F.col(value)))

    picks = []
    for name, p in probs.items():
        rank = (n - 1) * F.lit(float(p))
        low = F.floor(rank)
        picks += [at(low).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}"),
                  F.max(rank - low).alias(f"__t_{name}")]
    picked = ranked.groupBy(*group).agg(*picks)
    return picked.select(
        *group,
        *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__t_{n}")).alias(n)
          for n in probs],
    )


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "position") -> DataFrame:
    """First k rows of each group. Spark cuts each map task to k rows before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
