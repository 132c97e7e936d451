"""Daily bars: rolling market features, forward drawdown, price breaks.

``prices`` is keyed by (symbol, trade_date), so a symbol holds at most one row per calendar day and
a window over one symbol is bounded whatever the table's size. The per-bar functions (``rolling_*``,
``forward_drawdown``) give a value for every bar. The panel needs values at a few dates only, so
``market_and_label`` reads slices of each symbol's bars around those dates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.scalars import log_or_null
from pitpanel.operators.asof import asof_backward

def _bars():
    return Window.partitionBy("symbol").orderBy("trade_date")


def lagged_return(bars: int = 90, price: str = "adj_close") -> Column:
    past = F.lag(price, bars).over(_bars())
    return F.when(past != 0, F.col(price) / past) - 1


def log_return(price: str = "adj_close") -> Column:
    past = F.lag(price).over(_bars())
    return F.when(past > 0, log_or_null(F.col(price) / past))


def rolling_max(column: str, bars: int, minimum: int) -> Column:
    frame = _bars().rowsBetween(-(bars - 1), 0)
    return F.when(F.count(column).over(frame) >= minimum, F.max(column).over(frame))


def rolling_std(column: str, bars: int = 90, per_year: int = 252) -> Column:
    frame = _bars().rowsBetween(-(bars - 1), 0)
    return F.when(F.count(column).over(frame) >= bars // 2,
                  F.stddev_samp(column).over(frame) * F.lit(math.sqrt(per_year)))


def rolling_median(column: str, bars: int = 90) -> Column:
    frame = _bars().rowsBetween(-(bars - 1), 0)
    return F.when(F.count(column).over(frame) >= bars // 2, F.percentile(column, F.lit(0.5)).over(frame))


def forward_drawdown(horizon: int = 60, price: str = "adj_close") -> Column:
    """Worst return over the next ``horizon`` bars against this bar; NULL unless all bars exist."""
    frame = _bars().rowsBetween(1, horizon)
    full = F.count(price).over(frame) == horizon
    return F.when(full & (F.col(price) > 0), F.min(price).over(frame) / F.col(price) - 1)


def price_breaks(prices: DataFrame, floor: float = -0.35) -> DataFrame:
    """One-bar returns below the floor: (symbol, trade_date, prev_close, close, bar_return)."""
    marked = prices.select(
        "symbol", "trade_date", F.lag("adj_close").over(_bars()).alias("prev_close"),
        F.col("adj_close").alias("close"), lagged_return(1).alias("bar_return"))
    return marked.where(F.col("bar_return") < floor)


def numbered_bars(prices: DataFrame, *, return_bars: int = 90, floor: float = -0.35) -> DataFrame:
    """Bars with their position from 0, running returns and the nearest break on either side.

    The NULL filter is what a join on symbol would add later; having it here lets all uses share one shuffle.
    """
    base = prices.where(F.col("symbol").isNotNull()).select(
        "symbol", "trade_date", "adj_close", "volume",
        (F.row_number().over(_bars()) - 1).alias("pos"),
        log_return().alias("log_return"),
        lagged_return(return_bars).alias("lagged_return"),
        (lagged_return(1) < floor).alias("is_break"),
        F.count("*").over(Window.partitionBy("symbol")).alias("n_bars"))
    at = F.when(F.col("is_break"), F.col("pos"))
    before = _bars().rowsBetween(Window.unboundedPreceding, 0)
    # Reversed order keeps the look-ahead linear; a frame that ends in the far future would not be.
    after = Window.partitionBy("symbol").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, -1)
    return base.select(
        "*", F.max(at).over(before).alias("last_break"), F.min(at).over(after).alias("next_break"))


def median_of(ordered: Column) -> Column:
    """Median of an ordered array without NULLs; NULL when it is empty."""
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return low * 0.5 + high * 0.5


def deviation(values: str) -> Column:
    """Sample standard deviation of an array without NULLs; NULL below two values."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / n
    # The mean travels in the accumulator: inside the step it would be computed again for every value.
    start = F.struct(mean.alias("mean"), F.lit(0.0).alias("total"))
    squares = F.aggregate(values, start, lambda a, x: F.struct(
        a["mean"].alias("mean"), (a["total"] + (x - a["mean"]) * (x - a["mean"])).alias("total")), lambda a: a["total"])
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


ANCHOR = ["pos", "adj_close", "lagged_return", "n_bars", "last_break", "next_break"]


def anchor(observations: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, observation_date) with the bar in force on that date."""
    keys = observations.select("symbol", "observation_date")
    return asof_backward(keys, bars, ["symbol"], "observation_date", "trade_date", ANCHOR)


def benchmark_returns(dates: DataFrame, benchmark: DataFrame, return_bars: int = 90) -> DataFrame:
    """(observation_date, bench_return) as of each date. Both inputs are calendars, hence small."""
    calendar = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    past = F.lag("adj_close", return_bars).over(calendar)
    series = benchmark.select("trade_date", (F.col("adj_close") / past - 1).alias("bench_return"))
    return asof_backward(dates, series, [], "observation_date", "trade_date", ["bench_return"])


def market_and_label(
    observations: DataFrame,
    prices: DataFrame,
    benchmark: DataFrame,
    w,
    *,
    blank_breaks: bool = False,
    void_breaks: bool = False,
    market: bool = True,
    label: bool = True,
    marks: bool = False,
) -> DataFrame:
    """Market features and label per (symbol, observation_date), from one pass over the bars.

    A symbol's bars become one row of arrays in day order, which the calendar bounds. A date finds the bar in force in them and
    reads the slices around it, so nothing is multiplied by window length, grouped by date or sorted again.

    ``blank_breaks`` voids a feature when a break lies within its own window, both ends included;
    ``void_breaks`` voids the label when a break lies in the bars after the entry, up to the horizon.
    Only the nearest break matters for either test, so both are plain comparisons. ``marks`` adds what they took away:
    ``n_blanked`` (features of the row) and ``is_voided`` (whether its label).
    """
    turnover = F.col("adj_close") * F.coalesce("volume", F.lit(0.0))
    fields = ["trade_date", "adj_close", *(["turnover"] if market else [])]
    # Bars travel as few columns: what is sorted and gathered here is the widest thing the panel holds, and it must fit a task's memory.
    # A bar without a day keeps its place, before all others, but has no value for any date.
    narrow = prices.where(F.col("symbol").isNotNull()).withColumn("turnover", turnover).select("symbol", F.struct(*fields).alias("bar"))
    history = narrow.groupBy("symbol").agg(F.sort_array(F.collect_list("bar")).alias("bars")).select(
        "symbol", *[F.col(f"bars.{c}").alias(f"all_{c}") for c in fields])
    closes = F.col("all_adj_close")
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice(closes, 1, F.size(closes) - 1))
    fell = F.zip_with(closes, before, lambda x, past: F.when(past != 0, x / past) - 1 < w.break_floor)
    history = history.select(
        "*", F.size(F.filter("all_trade_date", lambda d: d.isNull())).alias("undated"),
        known(F.transform(fell, lambda hit, i: F.when(hit, i))).alias("breaks"),
        *([F.zip_with(closes, before, lambda x, past: F.when(past > 0, log_or_null(x / past))).alias("all_log_return")] if market else []))
    at = observations.select("symbol", "observation_date").distinct().join(history.hint("merge"), "symbol", "left")
    seen = F.col("observation_date")
    last = F.size(F.filter("all_trade_date", lambda d: d.isNull() | (d <= seen))) - 1
    found = at.withColumn("pos", last).withColumn("pos", F.when(F.get("all_trade_date", F.col("pos")).isNotNull(), F.col("pos")))

    def among_last(column: str, n: int) -> Column:
        start = F.greatest(F.col("pos") - n + 2, F.col("undated") + 1)
        return known(F.slice(column, start, F.col("pos") + 2 - start))

    entry = F.get("all_adj_close", F.col("pos"))
    here = [entry.alias("adj_close"), F.array_max(F.filter("breaks", lambda b: b <= F.col("pos"))).alias("last_break"),
            F.array_min(F.filter("breaks", lambda b: b > F.col("pos"))).alias("next_break")]
    windows = []
    if market:
        past = F.get("all_adj_close", F.col("pos") - w.return_bars)
        here.append((F.when(past != 0, entry / past) - 1).alias("lagged_return"))
        windows += [among_last("all_log_return", w.volatility_bars).alias("returns"), among_last("all_adj_close", w.drawdown_bars).alias("closes"),
                    among_last("all_turnover", w.turnover_bars).alias("turnovers")]
    if label:
        windows.append(known(F.slice("all_adj_close", F.col("pos") + 2, F.lit(w.horizon_bars))).alias("later"))
    found = found.select("symbol", "observation_date", "pos", F.size("all_trade_date").alias("n_bars"), *here, *windows)

    out = [F.col("symbol"), F.col("observation_date"), F.col("pos"), F.col("adj_close").alias("entry_price"),
           "last_break", "next_break"]
    if market:
        dates = observations.select("observation_date").distinct()
        # One row per observation date: bounded by the calendar.
        found = found.join(F.broadcast(benchmark_returns(dates, benchmark, w.return_bars)), "observation_date", "left")
        enough = F.col("n_bars") >= 2

        def hit_back(window: int) -> Column:
            return F.coalesce(F.col("pos") - F.col("last_break") <= window, F.lit(False)) if blank_breaks else F.lit(False)

        volatility = F.when(F.size("returns") >= w.volatility_bars // 2, deviation("returns") * math.sqrt(w.bars_per_year))
        top = F.array_max("closes")
        fall = F.when((F.size("closes") >= 2) & (top > 0), F.col("adj_close") / top - 1)
        median = F.when(F.size("turnovers") >= w.turnover_bars // 2, log_or_null(median_of(F.sort_array("turnovers"))))
        values = {
            "volatility_90d": (volatility, w.volatility_bars),
            "trailing_dd_60d": (fall, w.drawdown_bars),
            "return_90d": (F.col("lagged_return"), w.return_bars),
            "rel_return_90d": (F.col("lagged_return") - F.col("bench_return"), w.return_bars),
            "log_turnover_90d": (median, w.turnover_bars),
        }
        out += [F.when(enough, F.when(~hit_back(n), v)).alias(c) for c, (v, n) in values.items()]
        if marks:
            out.append(sum((F.when(enough & hit_back(n) & v.isNotNull(), 1).otherwise(0) for v, n in values.values()), F.lit(0)).alias("n_blanked"))
    if label:
        fall = F.when((F.size("later") == w.horizon_bars) & (F.col("adj_close") > 0),
                      F.array_min("later") / F.col("adj_close") - 1)
        if void_breaks:
            hit = F.coalesce(F.col("next_break") - F.col("pos") <= w.horizon_bars, F.lit(False))
            if marks:
                out.append((hit & fall.isNotNull()).alias("is_voided"))
            fall = F.when(~hit, fall)
        elif marks:
            out.append(F.lit(False).alias("is_voided"))
        found = found.withColumn("fwd_max_drawdown", fall)
        out += [
            F.col("fwd_max_drawdown"),
            (F.col("fwd_max_drawdown") <= w.threshold).cast("int").alias("label"),
            F.col("fwd_max_drawdown").isNotNull().cast("int").alias("label_is_valid")]
    return found.select(*out)


def nth_session_after(prices: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """(symbol, observation_date, session_end): the date n bars after the first bar on or after the date.

    Past the end of the history it is the last bar.
    """
    bars = prices.select("symbol", "trade_date", (F.row_number().over(_bars()) - 1).alias("pos"))
    sizes = prices.groupBy("symbol").agg((F.count("*") - 1).alias("last_pos"))
    placed = asof_backward(
        anchors.select("symbol", "observation_date", F.date_sub("observation_date", 1).alias("__eve")),
        bars, ["symbol"], "__eve", "trade_date", ["pos"])
    first = placed.select("symbol", "observation_date", (F.coalesce("pos", F.lit(-1)) + 1).alias("first_pos"))
    wanted = first.join(sizes, "symbol").where(F.col("first_pos") <= F.col("last_pos")).select(
        "symbol", "observation_date", F.least(F.col("first_pos") + n, F.col("last_pos")).cast("int").alias("pos"))
    return wanted.join(bars, ["symbol", "pos"]).select("symbol", "observation_date", F.col("trade_date").alias("session_end"))
