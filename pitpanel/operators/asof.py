"""As-of, range and interval joins.

As-of joins are written as union-and-carry: both sides are tagged, sorted once by (key, time, side)
and the last payload is carried along, which is linear in the rows. A key that may hold a large
share of the left rows is looked up once per distinct time, so no task orders more than a calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tagged(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str,
            payload: list[str], left_side: int) -> DataFrame:
    ours = left.select(*key, F.col(left_time).alias("__t"), F.lit(left_side).alias("__side"),
                       F.struct(*left.columns).alias("__row"))
    theirs = right.select(*key, F.col(right_time).alias("__t"), F.lit(1 - left_side).alias("__side"),
                          F.struct(*payload).alias("__pay"))
    return ours.unionByName(theirs, allowMissingColumns=True)


def _carry(tagged: DataFrame, parts: list[Column], left_side: int, forward: bool = False) -> DataFrame:
    order = [F.desc("__t"), F.desc("__side")] if forward else [F.col("__t"), F.col("__side")]
    run = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("__pay", F.last("__pay", ignorenulls=True).over(run)).where(
        F.col("__side") == left_side)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    left_time: str,
    right_time: str,
    payload: list[str],
    by_time: bool = False,
) -> DataFrame:
    """Left rows with the payload of the last right row at or before their time, else NULLs.

    The right side holds one row per key and day. When the left side may hold very many rows per key,
    ``by_time`` looks each distinct (key, time) up once and joins the answers back: what is ordered
    is then bounded by the calendar, and the join back is an equi-join that adaptive execution splits.
    """
    if {*key, left_time} & {*payload}:
        raise ValueError("payload columns must not repeat the key or the left time")
    if by_time:
        asked = left.select(*key, left_time).distinct()
        found = asof_backward(asked, right, key, left_time, right_time, [*payload])
        answers = found.select(*key, left_time, F.struct(*payload).alias("__pay"))
        return left.join(answers, [*key, left_time], "left").select(
            *[F.col(c) for c in left.columns], *[F.col(f"__pay.{c}").alias(c) for c in payload])
    tagged = _tagged(left, right, key, left_time, right_time, payload, left_side=1)
    carried = _carry(tagged, [F.col(k) for k in key] or [F.lit(0)], 1)
    return carried.select("__row.*", *[F.col(f"__pay.{c}").alias(c) for c in payload])


def asof_forward(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str,
                 payload: list[str]) -> DataFrame:
    """Left rows with the payload of the first right row at or after their time, else NULLs."""
    tagged = _tagged(left, right, key, left_time, right_time, payload, left_side=0)
    carried = _carry(tagged, [F.col(k) for k in key] or [F.lit(0)], 0, forward=True)
    return carried.select("__row.*", *[F.col(f"__pay.{c}").alias(c) for c in payload])


def range_sums(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    frames: dict[str, tuple[str, int, int]],
) -> DataFrame:
    """Per left row, sums of right columns over inclusive day ranges ``[t + low, t + high]``.

    ``frames``: output -> (right column, low, high). The right side is first summed per (key, day),
    so one key never holds more rows than the calendar has days.
    """
    columns = sorted({c for c, _, _ in frames.values()})
    daily = right.groupBy(key, F.col(right_time).alias("__t")).agg(*[F.sum(c).alias(c) for c in columns])
    both = left.select(key, F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__row")).unionByName(
        daily, allowMissingColumns=True)
    day = F.unix_date("__t")
    by_day = Window.partitionBy(key).orderBy(day)
    summed = both.select(
        "__row", *[F.sum(c).over(by_day.rangeBetween(low, high)).alias(out)
                   for out, (c, low, high) in frames.items()])
    return summed.where(F.col("__row").isNotNull()).select("__row.*", *frames)


def trading_calendar(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("trade_date").distinct()


def observation_dates(quarters: DataFrame, benchmark: DataFrame, lag_days: int = 30) -> DataFrame:
    """(quarter_end, observation_date): quarter end + lag, rolled forward to a trading day.

    NULL where the calendar ends before the target. Both sides are calendars, hence small.
    """
    targets = quarters.select("quarter_end", F.date_add("quarter_end", lag_days).alias("target"))
    rolled = asof_forward(targets, trading_calendar(benchmark), [], "target", "trade_date", ["trade_date"])
    return rolled.select("quarter_end", "target", F.col("trade_date").alias("observation_date"))


def breaks_in_bars(anchors: DataFrame, breaks: DataFrame, low: int, high: int) -> DataFrame:
    """Anchor rows with ``n_breaks``: breaks whose position lies in [pos + low, pos + high].

    anchors: (symbol, observation_date, pos); breaks: (symbol, break_pos). Breaks are rare one-bar
    moves and at most one per bar, so a symbol's list is bounded by the calendar.
    """
    offset = F.col("break_pos") - F.col("pos")
    joined = anchors.alias("a").join(
        breaks.alias("b"),
        (F.col("a.symbol") == F.col("b.symbol")) & offset.between(low, high), "left")
    return joined.groupBy("a.symbol", "observation_date", "pos").agg(F.count("break_pos").alias("n_breaks"))
