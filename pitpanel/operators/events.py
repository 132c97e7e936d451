"""Event features over day windows that close before the observation date.

Events are first summed per (symbol, day), with partial sums before the shuffle. A symbol that files
a third of all events therefore still holds at most one row per calendar day afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.scalars import rounded


def is_material(min_pct_equity: float = 0.01) -> Column:
    return F.coalesce("pct_equity", F.lit(0.0)) >= min_pct_equity


def filter_material(events: DataFrame, min_pct_equity: float = 0.01) -> DataFrame:
    return events.where(is_material(min_pct_equity))


def materiality_report(events: DataFrame, min_pct_equity: float = 0.01) -> DataFrame:
    kept = is_material(min_pct_equity)
    return events.agg(
        F.count("*").alias("total"), F.count_if(kept).alias("material"), F.count_if(~kept).alias("dropped"),
        F.countDistinct("symbol").alias("companies_total"),
        F.countDistinct(F.when(kept, F.col("symbol"))).alias("companies_material"),
        F.lit(float(min_pct_equity)).alias("min_pct_equity"))


def daily_events(events: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums per (symbol, day), and the next day with an event."""
    kind, pct = F.col("event_type"), F.col("pct_equity")

    def amount(word: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == word, pct)), F.lit(0.0))

    daily = events.groupBy(*extra_keys, "symbol", "event_date").agg(
        amount("creation").alias("created"), amount("release").alias("released"),
        F.count("*").alias("n_events"), F.count_if(kind == "invocation").alias("n_invoked"))
    later = Window.partitionBy(*extra_keys, "symbol").orderBy("event_date")
    return daily.withColumn("next_date", F.lead("event_date").over(later))


def _visible(observations: DataFrame, daily: DataFrame, lag_days: int, reach: int,
             extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Each observation with the event days of its longest window, and the last day before that."""
    ends = observations.select(*extra_keys, "symbol", "observation_date",
                               F.date_sub("observation_date", lag_days).alias("end_date")).distinct()
    day, end, nxt = F.col("event_date"), F.col("end_date"), F.col("next_date")
    same = F.col("o.symbol") == F.col("e.symbol")
    for k in extra_keys:
        same = same & (F.col(f"o.{k}") == F.col(f"e.{k}"))
    wanted = (day <= end) & ((day >= F.date_sub(end, reach)) | nxt.isNull() | (nxt > end))
    # The event days are already partitioned and sorted by symbol; a merge join keeps that.
    return ends.alias("o").join(daily.alias("e").hint("merge"), same & wanted, "left")


def _steady(total: Column) -> Column:
    """Sums of percentages to 9 places: equal windows stay equal whatever the order of summation."""
    return rounded(F.coalesce(total, F.lit(0.0)).cast("double"))


def _since(column: str, days: int) -> Column:
    inside = F.col("event_date") >= F.date_sub("end_date", days)
    return _steady(F.sum(F.when(inside, F.col(column))))


def event_features(
    observations: DataFrame,
    material: DataFrame,
    *,
    window_days: int = 90,
    invocation_days: int = 365,
    lag_days: int = 14,
) -> DataFrame:
    """Six features per (symbol, observation_date). No event means 0, and days-since stays NULL.

    Days since the last event count from the window's end, over all history.
    """
    seen = _visible(observations, daily_events(material), lag_days, max(window_days, invocation_days))
    return seen.groupBy(F.col("o.symbol").alias("symbol"), "observation_date").agg(
        _since("created", window_days).alias("event_created_90d"),
        _since("released", window_days).alias("event_released_90d"),
        _since("n_events", window_days).alias("event_count_90d"),
        F.max(F.date_diff("end_date", "event_date") * -1).alias("__last"),
        _since("n_invoked", invocation_days).alias("event_invocations_365d"),
    ).select(
        "symbol", "observation_date", "event_created_90d", "event_released_90d",
        _steady(F.col("event_created_90d") - F.col("event_released_90d")).alias("event_net_90d"),
        "event_count_90d", (-F.col("__last")).cast("double").alias("event_days_since"),
        "event_invocations_365d")


def window_features(observations: DataFrame, material: DataFrame, windows: tuple[int, ...],
                    lag_days: int = 14) -> DataFrame:
    """The count, net and created features rebuilt for several window lengths, in one pass."""
    seen = _visible(observations, daily_events(material), lag_days, max(windows))
    sums = seen.groupBy(F.col("o.symbol").alias("symbol"), "observation_date").agg(
        *[_since(c, w).alias(f"{c}_{w}") for w in windows for c in ("created", "released", "n_events")])
    per_window = F.explode(F.array(*[
        F.struct(F.lit(w).alias("window_days"), F.col(f"n_events_{w}").alias("count"),
                 _steady(F.col(f"created_{w}") - F.col(f"released_{w}")).alias("net"),
                 F.col(f"created_{w}").alias("created")) for w in windows]))
    return sums.select("symbol", "observation_date", per_window.alias("__w")).select(
        "symbol", "observation_date", "__w.*")


def threshold_features(observations: DataFrame, events: DataFrame, thresholds: tuple[float, ...], *,
                       window_days: int = 90, lag_days: int = 14) -> DataFrame:
    """Count and net features rebuilt for several materiality cuts, from one read of the events."""
    kind, pct = F.col("event_type"), F.col("pct_equity")

    def parts(i: int, t: float) -> list[Column]:
        kept = is_material(t)
        return [F.count_if(kept).alias(f"n_{i}"),
                F.coalesce(F.sum(F.when(kept & (kind == "creation"), pct)), F.lit(0.0)).alias(f"c_{i}"),
                F.coalesce(F.sum(F.when(kept & (kind == "release"), pct)), F.lit(0.0)).alias(f"r_{i}")]

    daily = events.groupBy("symbol", "event_date").agg(
        *[c for i, t in enumerate(thresholds) for c in parts(i, t)]).withColumn(
        "next_date", F.lit(None).cast("date"))
    ends = observations.select("symbol", "observation_date",
                               F.date_sub("observation_date", lag_days).alias("end_date")).distinct()
    inside = F.col("event_date").between(F.date_sub("end_date", window_days), F.col("end_date"))
    seen = ends.alias("o").join(daily.alias("e"), (F.col("o.symbol") == F.col("e.symbol")) & inside, "left")
    sums = seen.groupBy(F.col("o.symbol").alias("symbol"), "observation_date").agg(
        *[F.coalesce(F.sum(f"{p}_{i}"), F.lit(0.0)).cast("double").alias(f"{p}_{i}")
          for i in range(len(thresholds)) for p in "ncr"])
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("min_pct_equity"), F.col(f"n_{i}").alias("count"),
                 _steady(F.col(f"c_{i}") - F.col(f"r_{i}")).alias("net")) for i, t in enumerate(thresholds)]))
    return sums.select("symbol", "observation_date", rows.alias("__w")).select("symbol", "observation_date", "__w.*")
