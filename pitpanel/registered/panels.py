"""Queries that build the panel and its parts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators import asof, bars, events, trajectory
from pitpanel.plans import panel as plan
from pitpanel.registered.base import query, r
from pitpanel.settings import ALL_FEATURES, EVENT_FEATURES, MARKET_FEATURES, PANEL_COLUMNS, PLEDGE_FEATURES
from pitpanel.sources import adapters as src

W = src.STUDY.windows
_PLACES = {"log_turnover_90d": 9}


def tidy(df: DataFrame, columns: list[str] | None = None, places: int = 9) -> DataFrame:
    """Round every double so that summation order cannot show."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[fx.rounded(F.col(c), places).alias(c) if c in doubles else F.col(c)
                       for c in (columns or df.columns)])


def sql_tidy(columns: list[str], exact: tuple[str, ...] = (), places: int = 9) -> str:
    return ", ".join(c if c in exact else r(c, places) for c in columns)


def state(spark, sf):
    return trajectory.latest_known_filing(src.filings(spark, sf), W.observation_lag_days, src.FILING_ORDER)


def grid(spark, sf):
    return plan.observation_grid(src.symbols(spark, sf), src.quarter_array(), src.benchmark(spark, sf))


def traj(spark, sf):
    return trajectory.trajectory_features(state(spark, sf), src.quarter_array())


def panel(spark, sf, columns=None):
    return plan.build_panel(
        state(spark, sf), src.prices(spark, sf), src.benchmark(spark, sf), src.symbols(spark, sf),
        src.quarter_array(), W, src.events(spark, sf), columns=columns)


_INT = ("symbol", "observation_date", "quarter_end", "consecutive_rising_q", "is_stale", "label",
        "label_is_valid", "submission_date", "pledge_status", "filing_id", "line_no", "pos", "trade_date")
PANEL_SELECT = sql_tidy(PANEL_COLUMNS, _INT)


@query("pipe_build_panel", f"SELECT {PANEL_SELECT} FROM panel", "panel")
def build_panel(spark, sf):
    return tidy(panel(spark, sf))


_TRAJ = ["symbol", "quarter_end", "submission_date", "pledge_status", *PLEDGE_FEATURES, "is_stale"]


@query("pipe_trajectory", f"SELECT {sql_tidy(_TRAJ, _INT)} FROM trajectory", "trajectory")
def pipe_trajectory(spark, sf):
    return tidy(traj(spark, sf), _TRAJ)


_PIT = ["symbol", "observation_date", "quarter_end", "submission_date", "pledge_status", *PLEDGE_FEATURES, "is_stale"]


@query("pipe_point_in_time", f"SELECT {sql_tidy(_PIT, _INT)} FROM pit", "pit")
def pipe_point_in_time(spark, sf):
    return tidy(plan.point_in_time(grid(spark, sf), traj(spark, sf)), _PIT)


@query("pipe_observation_grid", "SELECT symbol, quarter_end, observation_date FROM grid", "grid")
def pipe_observation_grid(spark, sf):
    return grid(spark, sf)


_MARKET = ["symbol", "observation_date", *MARKET_FEATURES]


@query("pipe_market_features", f"SELECT {sql_tidy(_MARKET, _INT)} FROM market_raw", "market_raw")
def pipe_market_features(spark, sf):
    out = bars.market_and_label(grid(spark, sf), src.prices(spark, sf), src.benchmark(spark, sf), W, label=False)
    return tidy(out, _MARKET)


@query("pipe_blank_breaks", f"SELECT {sql_tidy(_MARKET, _INT)} FROM market", "market")
def pipe_blank_breaks(spark, sf):
    out = bars.market_and_label(
        grid(spark, sf), src.prices(spark, sf), src.benchmark(spark, sf), W, label=False, blank_breaks=True)
    return tidy(out, _MARKET)


_EVENT = ["symbol", "observation_date", *EVENT_FEATURES]


@query("pipe_event_features", f"""SELECT {sql_tidy(_EVENT, _INT)} FROM
(SELECT *, event_created_90d - event_released_90d AS event_net_90d FROM event_block) e""", "event_block")
def pipe_event_features(spark, sf):
    out = events.event_features(grid(spark, sf), events.filter_material(src.events(spark, sf)))
    return tidy(out, _EVENT)


_LABEL_SQL = """CASE WHEN {0} <= -0.32e0 THEN 1 WHEN {0} IS NOT NULL THEN 0 END AS label,
CASE WHEN {0} IS NOT NULL THEN 1 ELSE 0 END AS label_is_valid"""
_LABEL = ["symbol", "observation_date", "entry_price", "fwd_max_drawdown", "label", "label_is_valid"]


@query("pipe_label", f"""SELECT symbol, observation_date, {r('entry_price', 6)},
{r('fwd_raw', 9, 'fwd_max_drawdown')}, {_LABEL_SQL.format('fwd_raw')} FROM market_raw""", "market_raw")
def pipe_label(spark, sf):
    out = bars.market_and_label(grid(spark, sf), src.prices(spark, sf), src.benchmark(spark, sf), W, market=False)
    return tidy(out.withColumn("entry_price", fx.rounded(F.col("entry_price"), 6)), _LABEL)


@query("pipe_void_labels", f"""SELECT symbol, observation_date, {r('entry_price', 6)},
{r('fwd_max_drawdown')}, {_LABEL_SQL.format('fwd_max_drawdown')} FROM market""", "market")
def pipe_void_labels(spark, sf):
    out = bars.market_and_label(
        grid(spark, sf), src.prices(spark, sf), src.benchmark(spark, sf), W, market=False, void_breaks=True)
    return tidy(out.withColumn("entry_price", fx.rounded(F.col("entry_price"), 6)), _LABEL)
