"""Quarterly features on the complete grid, revisions, carried values and streaks.

Windows here partition by symbol over quarters, so a partition is bounded by the calendar.
Choosing one filing per quarter is an aggregate: a quarter with very many revisions is reduced
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _quarters():
    return Window.partitionBy("symbol").orderBy("quarter_end")


# Columns a skipped quarter takes over from the quarter before.
CARRIED = ["promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity", "submission_date", "pledge_status"]


def latest_known_filing(filings: DataFrame, lag_days: int = 30,
                        tie_break: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """One filing per (symbol, quarter_end): the last one submitted by the cutoff, else the first one.

    A row is its own rank, so a partial result holds a filing once; the first one is looked for among the late ones only.
    """
    key = ["symbol", "quarter_end"]
    rest = [c for c in filings.columns if c not in key]
    first = ["submission_date", *[c for c in tie_break if c not in key]]
    row = F.struct(*dict.fromkeys(first), *[c for c in rest if c not in first])
    in_time = F.coalesce(F.col("submission_date") <= F.date_add("quarter_end", lag_days), F.lit(False))
    picked = filings.groupBy(*key).agg(F.max(F.when(in_time, row)).alias("known"), F.min(F.when(~in_time, row)).alias("earliest"))
    return picked.select(*key, F.coalesce("known", "earliest").alias("__pick")).select(*key, *[f"__pick.{c}" for c in rest])


def last_per_quarter(state: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Last row per (symbol, quarter_end) along an explicit order."""
    key = ["symbol", "quarter_end"]
    rest = [c for c in state.columns if c not in key]
    picked = state.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__pick"))
    return picked.select(*key, "__pick.*")


def carried(column: str, limit: int = 1) -> Column:
    """Last known value of at most ``limit`` quarters ago."""
    return F.last(column, ignorenulls=True).over(_quarters().rowsBetween(-limit, 0))


def rising_streak(df: DataFrame, column: str, out: str = "consecutive_rising_q") -> DataFrame:
    """Length of the current run of strictly rising quarters.

    NULL when this or the previous quarter is unknown; a flat or falling quarter is 0. Every row
    that does not rise opens a new island, and the streak counts rows inside the island.
    """
    prev = F.lag(column).over(_quarters())
    marked = df.withColumn("__rise", F.coalesce((F.col(column) > prev).cast("int"), F.lit(0))).withColumn(
        "__known", F.col(column).isNotNull() & prev.isNotNull())
    so_far = _quarters().rowsBetween(Window.unboundedPreceding, 0)
    island = marked.withColumn("__island", F.sum(1 - F.col("__rise")).over(so_far))
    in_island = Window.partitionBy("symbol", "__island").orderBy("quarter_end").rowsBetween(
        Window.unboundedPreceding, 0)
    streak = F.when(F.col("__known"), F.sum("__rise").over(in_island)).cast("int")
    return island.withColumn(out, streak).drop("__rise", "__known", "__island")


def trajectory_features(state: DataFrame, quarters: Column, *, max_fill: int = 1,
                        rolling_max: int = 4) -> DataFrame:
    """Eight features per (symbol, quarter) for every symbol in ``state``; one row per quarter of the grid.

    ``state`` holds one row per (symbol, quarter_end); ``quarters`` is the array of quarter ends.
    UNAVAILABLE percentages are unknown, not zero.
    The fill works per column, so a blanked percentage is carried without marking the row stale.
    """
    grid = state.select("symbol").distinct().select("symbol", F.explode(quarters).alias("quarter_end"))
    blank = F.col("pledge_status") == "UNAVAILABLE"
    known = state.select(
        "symbol", "quarter_end", "submission_date", "pledge_status", "promoter_holding_pct",
        *[F.when(F.coalesce(blank, F.lit(False)), None).otherwise(F.col(c)).alias(c)
          for c in ("pledge_pct_promoter", "pledge_pct_equity")])
    full = grid.join(known, ["symbol", "quarter_end"], "left").withColumn(
        "__seen", F.col("pledge_status").isNotNull())
    filled = full.select("symbol", "quarter_end", "__seen", *[carried(c, max_fill).alias(c) for c in CARRIED])
    level = F.col("pledge_pct_promoter")
    one = level - F.lag(level, 1).over(_quarters())
    stepped = filled.select(
        "*",
        (~F.col("__seen") & F.col("pledge_status").isNotNull()).cast("int").alias("is_stale"),
        one.alias("pledge_chg_1q"),
        (level - F.lag(level, 2).over(_quarters())).alias("pledge_chg_2q"),
        F.max(level).over(_quarters().rowsBetween(-(rolling_max - 1), 0)).alias("pledge_max_4q"))
    accel = stepped.withColumn(
        "pledge_accel", F.col("pledge_chg_1q") - F.lag("pledge_chg_1q", 1).over(_quarters()))
    return rising_streak(accel, "pledge_pct_promoter").drop("__seen")
