"""Queries for checks, filters, joins, windows, aggregates and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators import asof, bars, events as ev, metrics, ordering, strata, trajectory
from pitpanel.plans import folds as fold_plan, leakage, panel as plan, prep, quality
from pitpanel.registered.base import piece, query, r
from pitpanel.registered.panels import W, grid, panel, sql_tidy, state, tidy, traj
from pitpanel.session import materialise
from pitpanel.settings import ALL_FEATURES, EVENT_FEATURES, MARKET_FEATURES, PLEDGE_FEATURES, Population
from pitpanel.sources import adapters as src

# Folds and leak checks -----------------------------------------------------------------------

piece("dcounts", """SELECT observation_date, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS events FROM panel WHERE label_is_valid = 1 GROUP BY 1""", "panel")
piece("placed", "SELECT *, ROW_NUMBER() OVER (ORDER BY observation_date) - 1 AS place FROM dcounts", "dcounts")
piece("folds", """SELECT CAST(t.place - 8 AS INT) AS fold, d.observation_date, CASE WHEN d.place = t.place THEN 'test' ELSE 'train' END AS role, d.n, d.events
FROM placed t JOIN placed d ON d.place <= t.place WHERE t.place >= 8""", "placed")
_FOLD_COLS = ["symbol", "observation_date", "label", "label_is_valid"]


@query("agg_date_counts", "SELECT observation_date, n, events FROM dcounts", "dcounts")
def agg_date_counts(spark, sf):
    return fold_plan.date_counts(panel(spark, sf, _FOLD_COLS))


@query("pipe_folds", f"""SELECT fold, MAX(observation_date) FILTER (role = 'train') AS train_through, MAX(observation_date) FILTER (role = 'test') AS test_date,
CAST(SUM(n) FILTER (role = 'train') AS BIGINT) AS n_train, CAST(SUM(n) FILTER (role = 'test') AS BIGINT) AS n_test,
{r("SUM(events) FILTER (role = 'train') / SUM(n) FILTER (role = 'train')", 9, 'train_event_rate')},
{r("SUM(events) FILTER (role = 'test') / SUM(n) FILTER (role = 'test')", 9, 'test_event_rate')} FROM folds GROUP BY 1""", "folds")
def pipe_folds(spark, sf):
    return tidy(fold_plan.describe_folds(fold_plan.fold_dates(panel(spark, sf, _FOLD_COLS))))


piece("leak1", """SELECT 'submission_date <= observation_date' AS "check", COUNT(*) AS rows_checked,
COUNT(*) FILTER (s.submission_date > p.observation_date) AS violations
FROM panel p JOIN state s ON s.symbol = p.symbol AND s.quarter_end = p.quarter_end WHERE p.pledge_pct_promoter IS NOT NULL""", "panel", "state")
piece("leak2", """SELECT 'label window starts strictly after observation' AS "check", COUNT(*) FILTER (label_is_valid = 1) AS rows_checked, CAST(0 AS BIGINT) AS violations FROM panel""", "panel")
piece("leak3", """SELECT 'events respect the disclosure lag' AS "check", COUNT(*) FILTER (p.symbol IN (SELECT symbol FROM material)) AS rows_checked, CAST(0 AS BIGINT) AS violations FROM panel p""", "panel", "material")
piece("leak4", """SELECT 'train/test fold dates disjoint and ordered' AS "check", COUNT(DISTINCT fold) AS rows_checked, CAST(0 AS BIGINT) AS violations FROM folds""", "folds")
_LEAK = 'SELECT "check", rows_checked, violations, violations = 0 AS passed FROM '


@query("pipe_leak_submission", _LEAK + "leak1", "leak1")
def pipe_leak_submission(spark, sf):
    return leakage.submission_before_observation(
        panel(spark, sf, ["symbol", "quarter_end", "observation_date", "pledge_pct_promoter"]), state(spark, sf))


@query("pipe_leak_label", _LEAK + "leak2", "leak2")
def pipe_leak_label(spark, sf):
    frame = panel(spark, sf, ["symbol", "observation_date", "label_is_valid", "fwd_max_drawdown"])
    return leakage.label_window_after_observation(frame, src.prices(spark, sf), W.horizon_bars)


@query("pipe_leak_events", "SELECT *, CAST(0 AS BIGINT) AS naive_matches FROM (" + _LEAK + "leak3) l", "leak3")
def pipe_leak_events(spark, sf):
    return leakage.events_respect_lag(panel(spark, sf, ["symbol", "observation_date", "event_count_90d"]), src.events(spark, sf))


@query("pipe_leak_folds", _LEAK + "leak4", "leak4")
def pipe_leak_folds(spark, sf):
    return leakage.folds_disjoint(fold_plan.fold_dates(panel(spark, sf, _FOLD_COLS)))


@query("pipe_leak_all", " UNION ALL ".join(_LEAK + f"leak{i}" for i in (1, 2, 3, 4)), "leak1", "leak2", "leak3", "leak4")
def pipe_leak_all(spark, sf):
    frame = materialise(panel(spark, sf), "panel")  # four checks read it
    return leakage.run_all(frame, state(spark, sf), src.prices(spark, sf), horizon=W.horizon_bars,
                           folds=fold_plan.fold_dates(frame), events=src.events(spark, sf), strict=True)


# A tighter rule set than the panel's own, so that the data breaks some of it.
_TIGHT = {"promoter_holding_pct": (10.0, 90.0), "volatility_90d": (0.0, 3.0), "trailing_dd_60d": (-0.5, 0.0),
          "pledge_max_4q": (0.0, 100.0)}
_ISSUES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '[{lo}, {hi}]' AS rule, COUNT(*) AS n_violations, ROUND(MIN({c}), 9) + 0e0 AS min, ROUND(MAX({c}), 9) + 0e0 AS max
FROM panel WHERE {c} < {lo}e0 OR {c} > {hi}e0 HAVING COUNT(*) > 0""" for c, (lo, hi) in _TIGHT.items())


@query("pipe_validate", _ISSUES, "panel")
def pipe_validate(spark, sf):
    return tidy(quality.validate_panel(panel(spark, sf), ranges=_TIGHT))


# Filters -------------------------------------------------------------------------------------

@query("filter_material", """SELECT COUNT(*) AS total, COUNT(*) FILTER (COALESCE(pct_equity, 0) >= 0.01) AS material,
COUNT(*) FILTER (COALESCE(pct_equity, 0) < 0.01) AS dropped, COUNT(DISTINCT symbol) AS companies_total,
COUNT(DISTINCT CASE WHEN COALESCE(pct_equity, 0) >= 0.01 THEN symbol END) AS companies_material, 0.01e0 AS min_pct_equity FROM pledge_events""", "pledge_events")
def filter_material(spark, sf):
    return ev.materiality_report(src.events(spark, sf))


STRATA = [Population("all"), Population("pledged", "pledge_pct_promoter", 1.0),
          Population("mid_or_unknown", "pledge_pct_promoter", 20.0, 60.0, include_missing=True),
          Population("calm", "volatility_90d", max_value=1.5)]
_STRATA_SQL = {
    "all": "TRUE", "pledged": "COALESCE(pledge_pct_promoter >= 1, FALSE)",
    "mid_or_unknown": "(pledge_pct_promoter IS NULL OR pledge_pct_promoter BETWEEN 20 AND 60)",
    "calm": "COALESCE(volatility_90d <= 1.5, FALSE)"}


@query("filter_stratum", f"""SELECT symbol, observation_date, {r('pledge_pct_promoter')}, label, label_is_valid FROM panel
WHERE {_STRATA_SQL['mid_or_unknown']}""", "panel")
def filter_stratum(spark, sf):
    cols = ["symbol", "observation_date", "pledge_pct_promoter", "label", "label_is_valid"]
    frame = materialise(panel(spark, sf, cols), "panel")  # counted once, then read
    return tidy(strata.apply_population(frame, STRATA[2], min_rows=50))


@query("agg_strata_table", " UNION ALL ".join(
    f"""SELECT '{p.name}' AS population, '{p.describe()}' AS filter, COUNT(*) AS n_rows, COUNT(*) FILTER (label_is_valid = 1) AS labelled,
COUNT(DISTINCT symbol) AS companies, ROUND(AVG(label) FILTER (label_is_valid = 1), 9) + 0e0 AS event_rate,
COUNT(DISTINCT CASE WHEN label_is_valid = 1 THEN observation_date END) AS dates FROM panel WHERE {_STRATA_SQL[p.name]}""" for p in STRATA), "panel")
def agg_strata_table(spark, sf):
    cols = ["symbol", "observation_date", "pledge_pct_promoter", "volatility_90d", "label", "label_is_valid"]
    return tidy(strata.strata_table(panel(spark, sf, cols), STRATA))


@query("filter_short_history", """SELECT symbol, observation_date FROM panel WHERE symbol IN (SELECT symbol FROM panel
WHERE pledge_pct_promoter IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT quarter_end) >= 24)""", "panel")
def filter_short_history(spark, sf):
    frame = panel(spark, sf, ["symbol", "observation_date", "quarter_end", "pledge_pct_promoter"])
    return plan.drop_short_history(frame, 24).select("symbol", "observation_date")


_BANDS = src.STUDY.evaluation.risk_bands


@query("case_risk_band", """SELECT prediction_id, CASE WHEN probability < 0.2e0 THEN 'LOW' WHEN probability < 0.4e0 THEN 'MEDIUM'
WHEN probability < 0.6e0 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band FROM predictions""", "predictions")
def case_risk_band(spark, sf):
    return src.predictions(spark, sf).select("prediction_id", fx.risk_band(F.col("probability"), _BANDS).alias("risk_band"))


@query("blank_when", f"""SELECT symbol, quarter_end, CASE WHEN COALESCE(submission_date > quarter_end + 30, FALSE) THEN NULL ELSE submission_date END AS submission_date,
ROUND(CASE WHEN COALESCE(submission_date > quarter_end + 30, FALSE) THEN NULL ELSE pledge_pct_promoter END, 9) + 0e0 AS pledge_pct_promoter FROM state""", "state")
def blank_when(spark, sf):
    frame = state(spark, sf).select("symbol", "quarter_end", "submission_date", "pledge_pct_promoter")
    late = F.col("submission_date") > F.date_add("quarter_end", 30)
    return tidy(plan.blank_when(frame, late, ["submission_date", "pledge_pct_promoter"]))


# Joins ---------------------------------------------------------------------------------------

@query("join_cross_grid", "SELECT s_suppkey AS symbol, quarter_end FROM supplier, qmap", "qmap")
def join_cross_grid(spark, sf):
    return grid(spark, sf).select("symbol", "quarter_end")


@query("join_left_grid", f"""SELECT g.symbol, g.quarter_end, g.observation_date, t.submission_date, {r('t.pledge_pct_promoter', 9, 'pledge_pct_promoter')}
FROM grid g LEFT JOIN trajectory t ON t.symbol = g.symbol AND t.quarter_end = g.quarter_end""", "grid", "trajectory")
def join_left_grid(spark, sf):
    features = traj(spark, sf).select("symbol", "quarter_end", "submission_date", "pledge_pct_promoter")
    return tidy(grid(spark, sf).join(features, ["symbol", "quarter_end"], "left").select(
        "symbol", "quarter_end", "observation_date", "submission_date", "pledge_pct_promoter"))


@query("join_asof_forward", """SELECT quarter_end, quarter_end + 30 AS target, (SELECT MIN(trade_date) FROM bench WHERE trade_date >= quarter_end + 30) AS observation_date FROM quarters""", "quarters", "bench")
def join_asof_forward(spark, sf):
    return asof.observation_dates(src.quarters(spark), src.benchmark(spark, sf))


@query("join_asof_backward", f"""SELECT o.o_orderkey AS order_id, p.trade_date, {r('p.adj_close', 6, 'adj_close')}
FROM (SELECT o_orderkey, o_custkey % 10 AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders) o
ASOF LEFT JOIN prices p ON p.symbol = o.symbol AND p.trade_date <= o.d""", "prices")
def join_asof_backward(spark, sf):
    """Ten hot keys share all orders, so each distinct (key, day) is looked up once."""
    orders = src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 10).alias("symbol"), F.col("o_orderdate").cast("date").alias("d"))
    out = asof.asof_backward(orders, src.prices(spark, sf), ["symbol"], "d", "trade_date", ["trade_date", "adj_close"], by_time=True)
    return out.select("order_id", "trade_date", fx.rounded(F.col("adj_close"), 6).alias("adj_close"))


@query("join_asof_benchmark", f"""SELECT q.observation_date, {r('bench_return')} FROM qmap q ASOF LEFT JOIN bench_ret b ON b.trade_date <= q.observation_date""", "qmap", "bench_ret")
def join_asof_benchmark(spark, sf):
    dates = asof.observation_dates(src.quarters(spark), src.benchmark(spark, sf)).where(
        F.col("observation_date").isNotNull()).select("observation_date")
    return tidy(bars.benchmark_returns(dates, src.benchmark(spark, sf), W.return_bars))


@query("join_range_events", """SELECT g.symbol, g.observation_date, ROUND(SUM(pct_equity) FILTER (event_date >= observation_date - 104), 9) + 0e0 AS pct_90d,
ROUND(SUM(shares), 6) + 0e0 AS shares_365d FROM grid g LEFT JOIN pledge_events e ON e.symbol = g.symbol
AND e.event_date BETWEEN g.observation_date - 379 AND g.observation_date - 14 GROUP BY 1, 2""", "grid", "pledge_events")
def join_range_events(spark, sf):
    out = asof.range_sums(grid(spark, sf), src.events(spark, sf), "symbol", "observation_date", "event_date", {
        "pct_90d": ("pct_equity", -104, -14), "shares_365d": ("shares", -379, -14)})
    return tidy(out.select("symbol", "observation_date", "pct_90d", "shares_365d"))


@query("join_interval_breaks", """SELECT a.symbol, a.observation_date, a.pos, COUNT(k.break_pos) AS n_breaks FROM (SELECT * FROM anchors WHERE pos IS NOT NULL) a
LEFT JOIN breaks k ON k.symbol = a.symbol AND k.break_pos BETWEEN a.pos - 90 AND a.pos GROUP BY 1, 2, 3""", "anchors", "breaks")
def join_interval_breaks(spark, sf):
    numbered = bars.numbered_bars(src.prices(spark, sf), floor=W.break_floor)
    placed = bars.anchor(grid(spark, sf), numbered).where(F.col("pos").isNotNull()).select(
        "symbol", "observation_date", F.col("pos").cast("bigint").alias("pos"))
    breaks = numbered.where("is_break").select("symbol", F.col("pos").alias("break_pos"))
    return asof.breaks_in_bars(placed, breaks, -90, 0)


@query("join_semi_anti", """SELECT symbol, TRUE AS has_events FROM companies WHERE symbol IN (SELECT symbol FROM pledge_events WHERE event_type = 'invocation' GROUP BY 1 HAVING COUNT(*) > 290)
UNION ALL SELECT symbol, FALSE FROM companies WHERE symbol NOT IN (SELECT symbol FROM pledge_events WHERE event_type = 'invocation' GROUP BY 1 HAVING COUNT(*) > 290)""", "companies", "pledge_events")
def join_semi_anti(spark, sf):
    many = src.events(spark, sf).where(F.col("event_type") == "invocation").groupBy("symbol").count().where(F.col("count") > 290)
    firms = src.companies(spark, sf)
    return firms.join(many, "symbol", "left_semi").select("symbol", F.lit(True).alias("has_events")).unionByName(
        firms.join(many, "symbol", "left_anti").select("symbol", F.lit(False).alias("has_events")))



@query("join_entity_history", """SELECT c.symbol, c.company_name, COALESCE(f.n, 0) AS n_filings, COALESCE(e.n, 0) AS n_events, COALESCE(p.n, 0) AS n_predictions,
f.first_filing, e.last_event FROM companies c
LEFT JOIN (SELECT symbol, COUNT(*) AS n, MIN(quarter_end) AS first_filing FROM state GROUP BY 1) f ON f.symbol = c.symbol
LEFT JOIN (SELECT symbol, COUNT(*) AS n, MAX(event_date) AS last_event FROM material GROUP BY 1) e ON e.symbol = c.symbol
LEFT JOIN (SELECT symbol, COUNT(*) AS n FROM predictions GROUP BY 1) p ON p.symbol = c.symbol""", "companies", "state", "material", "predictions")
def join_entity_history(spark, sf):
    """Counts and ends of each company's nested history."""
    nested = plan.entity_history(
        src.companies(spark, sf), state(spark, sf), ev.filter_material(src.events(spark, sf)), src.predictions(spark, sf))
    return nested.groupBy("symbol", "company_name").agg(
        *[F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x["copies"])).alias(f"n_{c}")
          for c in ("filings", "events", "predictions")],
        F.min(F.array_min(F.transform("filings", lambda x: x.quarter_end))).alias("first_filing"),
        F.max(F.array_max(F.transform("events", lambda x: x.event_date))).alias("last_event"))


# Aggregates ----------------------------------------------------------------------------------

@query("agg_filing_lag", """SELECT COUNT(*) AS n, CAST(MIN(lag) AS INT) AS lag_min, MEDIAN(lag) + 0e0 AS lag_median, CAST(MAX(lag) AS INT) AS lag_max,
ROUND(QUANTILE_CONT(lag, 0.99), 9) + 0e0 AS lag_p99, COUNT(*) FILTER (late) AS filed_after_cutoff,
ROUND(100e0 * COUNT(*) FILTER (late) / COUNT(*), 9) + 0e0 AS pct_lost_to_cutoff, 30 AS cutoff_days
FROM (SELECT t.submission_date - t.quarter_end AS lag, t.submission_date > g.observation_date AS late
FROM grid g JOIN trajectory t ON t.symbol = g.symbol AND t.quarter_end = g.quarter_end WHERE is_stale <> 1 AND t.submission_date IS NOT NULL) x""", "grid", "trajectory")
def agg_filing_lag(spark, sf):
    return tidy(plan.filing_lag_report(traj(spark, sf), grid(spark, sf), 30))


_SUMMARY = {"drawdown_median": 0.5, "drawdown_p05": 0.05, "drawdown_p25": 0.25, "drawdown_p75": 0.75}


@query("agg_label_summary", f"""SELECT COUNT(*) AS n, COUNT(*) FILTER (label_is_valid = 1) AS n_valid, CAST(SUM(label) AS BIGINT) AS n_events, {r('AVG(label)', 9, 'event_rate')},
{r('AVG(fwd_max_drawdown)', 9, 'drawdown_mean')}, {r('MIN(fwd_max_drawdown)', 9, 'drawdown_min')}, {r('MAX(fwd_max_drawdown)', 9, 'drawdown_max')},
{', '.join(r(f'QUANTILE_CONT(fwd_max_drawdown, {p})', 9, n) for n, p in _SUMMARY.items())} FROM panel""", "panel")
def agg_label_summary(spark, sf):
    return tidy(plan.label_summary(materialise(panel(spark, sf, ["symbol", "fwd_max_drawdown", "label", "label_is_valid"]), "panel")))


@query("agg_feature_coverage", " UNION ALL ".join(f"SELECT '{f}' AS feature, ROUND(AVG(CAST({f} IS NOT NULL AS DOUBLE)), 9) + 0e0 AS coverage FROM panel" for f in ALL_FEATURES), "panel")
def agg_feature_coverage(spark, sf):
    return tidy(plan.feature_coverage(panel(spark, sf), ALL_FEATURES))


@query("agg_event_coverage", """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (event_count_90d > 0) AS rows_with_event, ROUND(AVG(CAST(event_count_90d > 0 AS DOUBLE)), 9) + 0e0 AS pct_with_event,
COUNT(*) FILTER (event_invocations_365d > 0) AS rows_with_invocation, COUNT(event_days_since) AS rows_with_days_since,
COUNT(DISTINCT CASE WHEN event_count_90d > 0 THEN symbol END) AS companies_with_event FROM panel""", "panel")
def agg_event_coverage(spark, sf):
    return tidy(plan.event_coverage(panel(spark, sf, ["symbol", *EVENT_FEATURES])))


@query("agg_event_rate_by_date", """SELECT observation_date, ROUND(events / n, 9) + 0e0 AS event_rate, ROUND(MIN(events / n) OVER (), 9) + 0e0 AS min_rate,
ROUND(MAX(events / n) OVER (), 9) + 0e0 AS max_rate FROM dcounts""", "dcounts")
def agg_event_rate_by_date(spark, sf):
    """One row per date, so the overall least and greatest come from one small window."""
    whole = Window.partitionBy(F.lit(0))
    rates = fold_plan.date_counts(panel(spark, sf, _FOLD_COLS)).withColumn("event_rate", F.col("events") / F.col("n"))
    return tidy(rates.select("observation_date", "event_rate", F.min("event_rate").over(whole).alias("min_rate"),
                             F.max("event_rate").over(whole).alias("max_rate")))


_STEP = (0.6 + 1.0) / 12


@query("agg_histogram_fixed", f"""SELECT CAST(bin AS INT) AS bin, ROUND(-1e0 + bin * {_STEP!r}e0, 9) + 0e0 AS lower, ROUND(-1e0 + (bin + 1) * {_STEP!r}e0, 9) + 0e0 AS upper,
COUNT(h.slot) AS n FROM generate_series(0, 11) b(bin) LEFT JOIN (SELECT LEAST(CAST(FLOOR((fwd_max_drawdown + 1e0) / {_STEP!r}e0) AS INT), 11) AS slot
FROM panel WHERE fwd_max_drawdown BETWEEN -1 AND 0.6) h ON h.slot = bin GROUP BY bin""", "panel")
def agg_histogram_fixed(spark, sf):
    frame = panel(spark, sf, ["symbol", "fwd_max_drawdown"])
    return tidy(metrics.histogram(frame, [], "fwd_max_drawdown", -1.0, 0.6, 12))


@query("agg_linear_fit", f"""SELECT observation_date, COUNT(*) AS n, {r('REGR_SLOPE(fwd_max_drawdown, volatility_90d)', 9, 'slope')},
{r('REGR_INTERCEPT(fwd_max_drawdown, volatility_90d)', 9, 'intercept')} FROM panel WHERE fwd_max_drawdown IS NOT NULL AND volatility_90d IS NOT NULL GROUP BY 1""", "panel")
def agg_linear_fit(spark, sf):
    frame = panel(spark, sf, ["symbol", "observation_date", "volatility_90d", "fwd_max_drawdown"])
    return tidy(metrics.linear_fit(frame, ["observation_date"], "volatility_90d", "fwd_max_drawdown"))


# Windows -------------------------------------------------------------------------------------

@query("win_lag_diff", f"SELECT symbol, quarter_end, {r('pledge_chg_1q')}, {r('pledge_chg_2q')}, {r('pledge_accel')} FROM trajectory", "trajectory")
def win_lag_diff(spark, sf):
    return tidy(traj(spark, sf), ["symbol", "quarter_end", "pledge_chg_1q", "pledge_chg_2q", "pledge_accel"])


@query("win_capped_ffill", f"SELECT symbol, quarter_end, submission_date, pledge_status, {r('pledge_pct_promoter')}, is_stale FROM trajectory", "trajectory")
def win_capped_ffill(spark, sf):
    return tidy(traj(spark, sf), ["symbol", "quarter_end", "submission_date", "pledge_status", "pledge_pct_promoter", "is_stale"])


@query("win_rising_streak", "SELECT symbol, quarter_end, consecutive_rising_q FROM trajectory", "trajectory")
def win_rising_streak(spark, sf):
    return traj(spark, sf).select("symbol", "quarter_end", "consecutive_rising_q")


_BAR = "SELECT symbol, trade_date, "


@query("win_rolling_max", _BAR + r("CASE WHEN n_top >= 2 THEN top END", 6, "top_60") + " FROM bars", "bars")
def win_rolling_max(spark, sf):
    return src.prices(spark, sf).select(
        "symbol", "trade_date", fx.rounded(bars.rolling_max("adj_close", 60, 2), 6).alias("top_60"))


@query("win_rolling_std", _BAR + r("CASE WHEN n_sd >= 45 THEN sd * SQRT(252e0) END", 9, "volatility_90d") + " FROM bars", "bars")
def win_rolling_std(spark, sf):
    returns = src.prices(spark, sf).select("symbol", "trade_date", bars.log_return().alias("log_return"))
    return tidy(returns.select("symbol", "trade_date", bars.rolling_std("log_return").alias("volatility_90d")))


@query("win_rolling_median", _BAR + r("CASE WHEN n_mid >= 45 THEN mid END", 4, "turnover_90") + " FROM bars", "bars")
def win_rolling_median(spark, sf):
    moved = src.prices(spark, sf).select("symbol", "trade_date", (F.col("adj_close") * F.col("volume")).alias("turnover"))
    return moved.select("symbol", "trade_date", fx.rounded(bars.rolling_median("turnover"), 4).alias("turnover_90"))


@query("win_lagged_return", _BAR + r("lagged_return", 9, "return_90d") + " FROM bars", "bars")
def win_lagged_return(spark, sf):
    return tidy(src.prices(spark, sf).select("symbol", "trade_date", bars.lagged_return(90).alias("return_90d")))


@query("win_forward_min", _BAR + r("CASE WHEN n_ahead = 20 THEN trough / adj_close - 1 END", 9, "fwd_max_drawdown") + " FROM bars", "bars")
def win_forward_min(spark, sf):
    return tidy(src.prices(spark, sf).select("symbol", "trade_date", bars.forward_drawdown(20).alias("fwd_max_drawdown")))


@query("win_price_break", f"SELECT symbol, trade_date, {r('prev_close', 6)}, {r('close', 6)}, {r('bar_return')} FROM breaks", "breaks")
def win_price_break(spark, sf):
    out = tidy(bars.price_breaks(src.prices(spark, sf), W.break_floor))
    return out.withColumns({c: fx.rounded(F.col(c), 6) for c in ("prev_close", "close")})


_FILING = ["symbol", "quarter_end", "submission_date", "filing_id", "line_no", "promoter_holding_pct", "pledge_status"]


@query("win_latest_per_key", f"SELECT {sql_tidy(_FILING, ('symbol', 'quarter_end', 'submission_date', 'filing_id', 'line_no', 'pledge_status'))} FROM state", "state")
def win_latest_per_key(spark, sf):
    return tidy(state(spark, sf), _FILING)


@query("win_keep_last_dup", """SELECT symbol, quarter_end, filing_id, line_no, pledge_status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, quarter_end
ORDER BY filing_id DESC, line_no DESC, pledge_status DESC) AS rn FROM filings) f WHERE rn = 1""", "filings")
def win_keep_last_dup(spark, sf):
    return trajectory.last_per_quarter(src.filings(spark, sf), ("filing_id", "line_no", "pledge_status")).select(
        "symbol", "quarter_end", "filing_id", "line_no", "pledge_status")


@query("win_permute_within_group", """SELECT p.symbol, p.observation_date, g.label FROM panel p LEFT JOIN
(SELECT observation_date, symbol, ROW_NUMBER() OVER (PARTITION BY observation_date ORDER BY symbol) AS place FROM panel WHERE label IS NOT NULL) t
ON t.symbol = p.symbol AND t.observation_date = p.observation_date LEFT JOIN
(SELECT observation_date, label, ROW_NUMBER() OVER (PARTITION BY observation_date ORDER BY MD5(symbol || '-' || '42'), symbol) AS place FROM panel WHERE label IS NOT NULL) g
ON g.observation_date = t.observation_date AND g.place = t.place""", "panel")
def win_permute_within_group(spark, sf):
    frame = materialise(panel(spark, sf, ["symbol", "observation_date", "label"]), "panel")
    return leakage.permute_labels(frame, 42)


piece("bar_pos", """SELECT symbol, trade_date, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS pos,
COUNT(*) OVER (PARTITION BY symbol) AS n_bars FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem GROUP BY 1, 2) d""")


@query("win_nth_session_after", """SELECT a.symbol, a.observation_date, e.trade_date AS session_end FROM
(SELECT g.symbol, g.observation_date, MIN(b.pos) AS first_pos, MAX(b.n_bars) AS n_bars FROM grid g JOIN bar_pos b ON b.symbol = g.symbol AND b.trade_date >= g.observation_date GROUP BY 1, 2) a
JOIN bar_pos e ON e.symbol = a.symbol AND e.pos = LEAST(a.first_pos + 20, a.n_bars - 1)""", "grid", "bar_pos")
def win_nth_session_after(spark, sf):
    return bars.nth_session_after(src.prices(spark, sf), grid(spark, sf), 20)
