"""The point-in-time panel: one leak-free row per (symbol, quarter)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pitpanel.operators.asof import observation_dates
from pitpanel.operators.bars import market_and_label
from pitpanel.operators.events import event_features, filter_material
from pitpanel.operators.trajectory import trajectory_features
from pitpanel.session import dealt
from pitpanel.settings import EVENT_FEATURES, PANEL_COLUMNS, Windows

_FILED, _LATE = "__filed", "__late"


def observation_grid(symbols: DataFrame, quarters: Column, benchmark: DataFrame, lag_days: int = 30) -> DataFrame:
    """Every symbol at every usable quarter, with the date all symbols share.

    The quarters are unrolled inside each symbol's row, and the quarter -> date table is a calendar.
    """
    spark = symbols.sparkSession
    rows = spark.range(1).select(F.explode(quarters).alias("quarter_end"))
    usable = observation_dates(rows, benchmark, lag_days).where(F.col("observation_date").isNotNull())
    return symbols.select("symbol", F.explode(quarters).alias("quarter_end")).join(
        F.broadcast(usable.select("quarter_end", "observation_date")), "quarter_end").select(
        "symbol", "quarter_end", "observation_date")


def blank_when(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """NULL the columns where the condition holds, keeping the row."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(~hit, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def point_in_time(grid: DataFrame, features: DataFrame, *, strict: bool = True, mark: str | None = None) -> DataFrame:
    """THE rule: what was filed after the observation date is blanked; the row stays.

    ``strict`` asserts the rule again on the result, inside the same job. ``mark`` names a column that says which rows were filed late.
    """
    if "submission_date" not in features.columns:
        raise ValueError("features carry no submission_date, so the point-in-time rule cannot be applied")
    merged = grid.join(features, ["symbol", "quarter_end"], "left")
    late = F.col("submission_date") > F.col("observation_date")
    columns = [c for c in features.columns if c not in ("symbol", "quarter_end")]
    out = blank_when(merged.withColumn(_FILED, F.col("submission_date")), late, columns)
    if mark:
        out = out.withColumn(mark, F.coalesce(F.col(_FILED) > F.col("observation_date"), F.lit(False)))
    return (assert_point_in_time(out, columns, _FILED) if strict else out).drop(_FILED)


def assert_point_in_time(df: DataFrame, columns: list[str], filed: str = "submission_date") -> DataFrame:
    """Fail the job if a row carries a value of ``columns`` although ``filed`` is after its observation date.

    The test is a filter, so it runs whichever columns are read afterwards.
    """
    carries = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    message = F.concat(F.lit("filed after its observation date: "), F.col("symbol").cast("string"),
                       F.lit(" "), F.col("quarter_end").cast("string"))
    return df.where(F.when((F.col(filed) > F.col("observation_date")) & carries, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def filing_lag_report(features: DataFrame, grid: DataFrame, lag_days: int = 30) -> DataFrame:
    """What the cutoff costs. Carried rows are left out: their submission date is another quarter's.

    Lags are whole days, so the percentile's value table has as many entries as there are lags.
    """
    fresh = features.where(F.coalesce("is_stale", F.lit(0)) != 1).select(
        "symbol", "quarter_end", "submission_date")
    merged = grid.join(fresh, ["symbol", "quarter_end"]).where(F.col("submission_date").isNotNull()).select(
        F.date_diff("submission_date", "quarter_end").alias("lag"),
        (F.col("submission_date") > F.col("observation_date")).alias("late"))
    return merged.agg(
        F.count("*").alias("n"), F.min("lag").alias("lag_min"),
        F.percentile("lag", F.lit(0.5)).alias("lag_median"), F.max("lag").alias("lag_max"),
        F.percentile("lag", F.lit(0.99)).alias("lag_p99"), F.count_if("late").alias("filed_after_cutoff"),
        (100.0 * F.count_if("late") / F.nullif(F.count("*"), F.lit(0))).alias("pct_lost_to_cutoff"),
        F.lit(lag_days).alias("cutoff_days"))


def build_panel(
    state: DataFrame,
    prices: DataFrame,
    benchmark: DataFrame,
    symbols: DataFrame,
    quarters: Column,
    w: Windows,
    events: DataFrame | None = None,
    *,
    columns: list[str] | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """All steps in order, as one lazy plan.

    ``counts`` is filled by the job that reads the panel, without a pass of its own: n_rows, cells_blanked and labels_voided by price
    breaks, rows_without_bars, rows_filed_late.

    Bars, quarters and event days are each shuffled by symbol once. ``columns`` lets a caller skip
    whole branches: Catalyst prunes unused columns, and branches no column needs are not planned.
    """
    wanted = set(columns or PANEL_COLUMNS)
    grid = observation_grid(symbols, quarters, benchmark, w.observation_lag_days)
    trajectory = trajectory_features(
        state, quarters, max_fill=w.max_fill_quarters, rolling_max=w.rolling_max_quarters)
    frame = point_in_time(grid, trajectory, mark=_LATE if counts else None)
    bars = market_and_label(grid, prices, benchmark, w, blank_breaks=True, void_breaks=True, marks=counts is not None)
    frame = frame.join(bars.drop("pos", "last_break", "next_break", *([] if counts else ["entry_price"])),
                       ["symbol", "observation_date"], "left")
    if wanted & set(EVENT_FEATURES):
        if events is None:
            frame = frame.select("*", *[
                F.lit(None if c == "event_days_since" else 0.0).cast("double").alias(c) for c in EVENT_FEATURES])
        else:
            block = event_features(
                grid, filter_material(events, w.min_pct_equity), window_days=w.event_days,
                invocation_days=w.invocation_days, lag_days=w.disclosure_lag_days)
            frame = frame.join(block, ["symbol", "observation_date"], "left")
    frame = frame.withColumn("is_stale", F.coalesce("is_stale", F.lit(0))).withColumn(
        "label_is_valid", F.coalesce("label_is_valid", F.lit(0)))
    if counts:
        frame = frame.observe(
            counts, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("n_blanked"), F.lit(0)).alias("cells_blanked"),
            F.count_if("is_voided").alias("labels_voided"), F.count_if(F.col("entry_price").isNull()).alias("rows_without_bars"),
            F.count_if(_LATE).alias("rows_filed_late"))
    return frame.select(*[c for c in PANEL_COLUMNS if c in wanted])


def drop_short_history(panel: DataFrame, min_quarters: int = 3) -> DataFrame:
    """Keep symbols with enough observed quarters; a symbol never observed goes too."""
    seen = F.countDistinct(F.when(F.col("pledge_pct_promoter").isNotNull(), F.col("quarter_end")))
    long_enough = panel.groupBy("symbol").agg(seen.alias("n")).where(F.col("n") >= min_quarters)
    return panel.join(long_enough.select("symbol"), "symbol", "left_semi")


def label_summary(panel: DataFrame) -> DataFrame:
    """One row: counts, event rate and the drawdown's distribution over valid rows."""
    from pitpanel.operators.ordering import quantiles

    ok = F.col("label_is_valid") == 1
    dd = F.when(ok, F.col("fwd_max_drawdown"))
    base = panel.agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_valid"),
        F.sum(F.when(ok, F.col("label"))).cast("bigint").alias("n_events"),
        F.avg(F.when(ok, F.col("label"))).alias("event_rate"), F.avg(dd).alias("drawdown_mean"),
        F.min(dd).alias("drawdown_min"), F.max(dd).alias("drawdown_max")).withColumn("k", F.lit(1))
    spreads = quantiles(
        panel.where(ok).select(F.lit(1).alias("k"), "fwd_max_drawdown"), ["k"], "fwd_max_drawdown",
        {"drawdown_median": 0.5, "drawdown_p05": 0.05, "drawdown_p25": 0.25, "drawdown_p75": 0.75})
    return base.join(F.broadcast(spreads), "k", "left").drop("k")


def feature_coverage(panel: DataFrame, features: list[str]) -> DataFrame:
    """(feature, coverage): share of rows with a value, for all features in one pass."""
    wide = panel.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features])
    return wide.unpivot([], features, "feature", "coverage")


def event_coverage(panel: DataFrame) -> DataFrame:
    active = F.coalesce(F.col("event_count_90d") > 0, F.lit(False))
    return panel.agg(
        F.count("*").alias("n_rows"), F.count_if(active).alias("rows_with_event"),
        F.avg(active.cast("double")).alias("pct_with_event"),
        F.count_if(F.col("event_invocations_365d") > 0).alias("rows_with_invocation"),
        F.count("event_days_since").alias("rows_with_days_since"),
        F.countDistinct(F.when(active, F.col("symbol"))).alias("companies_with_event"))


def entity_history(companies: DataFrame, state: DataFrame, events: DataFrame, predictions: DataFrame,
                   panel: DataFrame | None = None) -> DataFrame:
    """(symbol, company_name, industry, page, filings, events, predictions, panel): nested, sorted history.

    A page is a calendar month, whatever it holds; equal rows become one with ``copies``. A company without
    history keeps one row with empty arrays, and without a ``panel`` that block is left out.
    """
    blocks = {"filings": (state, "quarter_end"), "events": (events, "event_date"), "predictions": (predictions, "observation_date")}
    if panel is not None:
        blocks["panel"] = (panel, "observation_date")
    nested = {n: df.where(F.col("symbol").isNotNull()).select("symbol", F.struct(d, *[c for c in df.columns if c not in ("symbol", d)]).alias(n))
              for n, (df, d) in blocks.items()}
    # Rows of all blocks travel once, as they are, by symbol: copies, pages and the companies are then put together where they lie.
    every = dealt(reduce(DataFrame.unionByName, [
        rows.select("symbol", *[F.col(b) if b == n else F.lit(None).cast(nested[b].schema[b].dataType).alias(b) for b in blocks])
        for n, rows in nested.items()]), "symbol")
    once = every.groupBy("symbol", *blocks).agg(F.count("*").alias("copies"))
    day = F.coalesce(*[F.col(f"{n}.{d}") for n, (_, d) in blocks.items()])
    page = F.struct(F.year(day).alias("year"), F.month(day).alias("month")).alias("page")
    paged = once.groupBy("symbol", page).agg(*[
        F.sort_array(F.collect_list(F.when(F.col(n).isNotNull(), F.struct(f"{n}.*", "copies")))).alias(n) for n in blocks])
    out = companies.select("symbol", "company_name", "industry").join(paged, "symbol", "left")
    return out.select("symbol", "company_name", "industry", "page", *[
        F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in blocks])
