"""Leak checks. Each recomputes what it guards by another route, over all rows.

Every check returns one row: (check, rows_checked, violations, passed).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators.asof import asof_backward
from pitpanel.operators.events import filter_material
from pitpanel.operators.ordering import positions


def _result(name: str, df: DataFrame, checked: Column, violated: Column) -> DataFrame:
    bad = F.coalesce(violated, F.lit(False))
    return df.agg(F.lit(name).alias("check"), F.count_if(checked).alias("rows_checked"),
                  F.count_if(checked & bad).alias("violations")).withColumn("passed", F.col("violations") == 0)


def submission_before_observation(panel: DataFrame, state: DataFrame) -> DataFrame:
    filed = state.select("symbol", "quarter_end", "submission_date")
    merged = panel.select("symbol", "quarter_end", "observation_date", "pledge_pct_promoter").join(
        filed, ["symbol", "quarter_end"], "left")
    has_data = F.col("pledge_pct_promoter").isNotNull() & F.col("submission_date").isNotNull()
    return _result("submission_date <= observation_date", merged, has_data,
                   F.col("submission_date") > F.col("observation_date"))


def label_window_after_observation(panel: DataFrame, prices: DataFrame, horizon: int = 60,
                                   tolerance: float = 1e-6) -> DataFrame:
    """Recompute the drawdown from ranks of the bars after each date.

    The entry is the last bar at or before the date; the window is the first ``horizon`` bars after
    it, read over the ranks of the same symbol. An as-of join brings both to the label.
    """
    keys = ["symbol", "observation_date"]
    labelled = panel.where(F.col("label_is_valid") == 1).select(*keys, "fwd_max_drawdown")
    bars = prices.select("symbol", "trade_date", "adj_close")
    # A rank per (symbol, day) counts bars without touching the pipeline's own numbering.
    ranked = bars.withColumn("n", F.count("*").over(
        Window.partitionBy("symbol").orderBy("trade_date").rangeBetween(Window.unboundedPreceding, 0)))
    # The bars of the next ``horizon`` ranks, in the partition and order the ranks have already.
    ahead = Window.partitionBy("symbol").orderBy("n").rangeBetween(1, horizon)
    seen = ranked.select("symbol", "trade_date", F.col("adj_close").alias("entry"), F.min("adj_close").over(ahead).alias("trough"),
                         F.count("*").over(ahead).alias("n_bars"))
    entry = asof_backward(labelled, seen, ["symbol"], "observation_date", "trade_date", ["entry", "trough", "n_bars"]).where(
        F.col("symbol").isNotNull() & (F.col("n_bars") > 0))
    again = entry.groupBy(*keys, "fwd_max_drawdown", "entry").agg(
        F.min("trough").alias("trough"), F.sum("n_bars").alias("n_bars"))
    off = F.abs(F.col("trough") / F.col("entry") - 1 - F.col("fwd_max_drawdown"))
    limit = tolerance + 1e-5 * F.abs(F.col("fwd_max_drawdown"))
    return _result("label window starts strictly after observation", again,
                   F.col("n_bars") == horizon, off > limit)


def events_respect_lag(panel: DataFrame, events: DataFrame, *, lag_days: int = 14, window_days: int = 90,
                       min_pct_equity: float = 0.01) -> DataFrame:
    """Recount events with and without the disclosure buffer; the stored count must be the buffered one.

    Adds ``naive_matches``: rows whose stored count equals the recount without the buffer, and not the other.
    """
    daily = filter_material(events, min_pct_equity).groupBy("symbol", "event_date").agg(F.count("*").alias("n"))
    rows = panel.select("symbol", "observation_date", "event_count_90d")
    joined = rows.join(daily, "symbol").where(
        F.col("event_date").between(F.date_sub("observation_date", lag_days + window_days), F.col("observation_date")))
    inside = F.col("event_date") <= F.date_sub("observation_date", lag_days)
    recent = F.col("event_date") >= F.date_sub("observation_date", window_days)
    counted = joined.groupBy("symbol", "observation_date").agg(
        F.sum(F.when(inside, F.col("n"))).alias("buffered"), F.sum(F.when(recent, F.col("n"))).alias("naive"))
    known = daily.select("symbol").distinct()
    both = rows.join(known, "symbol", "left_semi").join(counted, ["symbol", "observation_date"], "left")
    stored, buffered = F.col("event_count_90d"), F.coalesce("buffered", F.lit(0))
    naive = F.coalesce("naive", F.lit(0))
    out = both.agg(
        F.lit("events respect the disclosure lag").alias("check"), F.count(stored).alias("rows_checked"),
        F.count_if(stored != buffered).alias("violations"),
        F.count_if((stored != buffered) & (stored == naive)).alias("naive_matches"))
    return out.withColumn("passed", F.col("violations") == 0)


def folds_disjoint(folds: DataFrame) -> DataFrame:
    """No date both trains and tests a fold, and every training date precedes the test date."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    day = F.col("observation_date")
    per_fold = folds.groupBy("fold").agg(
        F.max(F.when(train, day)).alias("last_train"), F.min(F.when(test, day)).alias("first_test"),
        (F.count("*") > F.countDistinct(day)).alias("overlap"))
    violated = F.col("overlap") | (F.col("last_train") >= F.col("first_test"))
    return _result("train/test fold dates disjoint and ordered", per_fold, F.lit(True), violated)


def run_all(panel: DataFrame, state: DataFrame, prices: DataFrame, *, horizon: int, folds: DataFrame | None = None,
            events: DataFrame | None = None, lag_days: int = 14, window_days: int = 90,
            min_pct_equity: float = 0.01, strict: bool = False) -> DataFrame:
    """All checks as rows. ``strict`` fails the job that reads them when one did not pass."""
    results = [submission_before_observation(panel, state), label_window_after_observation(panel, prices, horizon)]
    if events is not None:
        results.append(events_respect_lag(panel, events, lag_days=lag_days, window_days=window_days,
                                          min_pct_equity=min_pct_equity).drop("naive_matches"))
    if folds is not None:
        results.append(folds_disjoint(folds))
    out = reduce(DataFrame.unionByName, results)
    if strict:
        failed = F.raise_error(F.concat(F.lit("leakage check failed: "), F.col("check")))
        out = out.withColumn("passed", F.when(F.col("passed"), True).otherwise(failed.cast("boolean")))
    return out


def permute_labels(panel: DataFrame, seed: int, date: str = "observation_date") -> DataFrame:
    """Shuffle known labels inside each date; unknown labels stay where they are.

    Rows get two numbers inside their date, by symbol and by a seeded md5; the label travels from the
    row with one number to the row with the other. Both orders are split, so a huge date is no problem.
    """
    known = panel.where(F.col("label").isNotNull())
    mark = F.md5(F.concat_ws("-", F.col("symbol").cast("string"), F.lit(str(seed))))
    keys = known.select(date, "symbol", "label", mark.alias("mark"))
    taken = positions(keys, [date], ["symbol"], "place", "size").select(date, "symbol", "place")
    given = positions(keys, [date], ["mark", "symbol"], "place", "size").select(
        date, "place", F.col("label").alias("__label"))
    shuffled = taken.join(given, [date, "place"]).select(date, "symbol", "__label")
    return panel.join(shuffled, [date, "symbol"], "left").withColumn("label", F.col("__label")).select(*panel.columns)
