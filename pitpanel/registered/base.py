"""Registry of runnable queries, and the SQL pieces their DuckDB checks are composed of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitpanel.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PIECES: dict[str, tuple[tuple[str, ...], str]] = {}


def piece(name: str, sql: str, *needs: str) -> None:
    """Register a named subquery of the check SQL and what it reads."""
    PIECES[name] = (needs, sql)


def compose(final: str, *needs: str) -> str:
    """WITH clause over the needed pieces, in dependency order, followed by the final select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in PIECES[name][0]:
                visit(dep)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({PIECES[n][1]})" for n in order) + "\n" + final


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query, and with ``sql`` its check."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql, *needs)
        return fn

    return wrap


def r(expr: str, places: int = 9, alias: str | None = None) -> str:
    """SQL twin of ``scalars.rounded``."""
    return f"ROUND({expr}, {places}) + 0e0 AS {alias or expr}"


_LINEITEM = {"lineitem": "lineitem", "orders": "orders"}
piece("runs", adapters.RUNS.format(**_LINEITEM))
piece("run_metrics", adapters.METRICS.format(**_LINEITEM))
piece("predictions", adapters.PREDICTIONS.format(**_LINEITEM))
piece("explanations", adapters.EXPLANATIONS.format(**_LINEITEM))
piece("companies", """SELECT s_suppkey AS symbol, s_name AS company_name, n_name AS industry, s_acctbal AS acctbal,
CAST(s_acctbal >= 0 AS INT) AS in_universe FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
piece("prices", adapters.PRICES.format(**_LINEITEM))
piece("bench", adapters.BENCHMARK.format(**_LINEITEM))
piece("filings", adapters.FILINGS.format(**_LINEITEM))
piece("pledge_events", adapters.EVENTS.format(**_LINEITEM))
piece("oof", adapters.OOF.format(**_LINEITEM))
piece("quarters", """SELECT CAST(LAST_DAY(CAST(d AS DATE)) AS DATE) AS quarter_end
FROM generate_series(DATE '1995-03-01', DATE '2001-12-01', INTERVAL 3 MONTH) t(d)""")
piece("qmap", """SELECT quarter_end, MIN(trade_date) AS observation_date
FROM quarters JOIN bench ON trade_date >= quarter_end + 30 GROUP BY quarter_end""", "quarters", "bench")
piece("grid", "SELECT s_suppkey AS symbol, quarter_end, observation_date FROM supplier, qmap", "qmap")
_IN_TIME = ", ".join(f"CASE WHEN ok THEN {c} END DESC" for c in ("submission_date", *adapters.FILING_ORDER))
piece("state", f"""SELECT * EXCLUDE (rn, ok) FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, quarter_end ORDER BY ok DESC,
  {_IN_TIME}, submission_date, {", ".join(adapters.FILING_ORDER)}) AS rn
FROM (SELECT *, submission_date <= quarter_end + 30 AS ok FROM filings) e) x WHERE rn = 1""", "filings")
piece("traj_base", """SELECT g.symbol, g.quarter_end, s.submission_date, s.pledge_status, s.promoter_holding_pct,
  CASE WHEN s.pledge_status <> 'UNAVAILABLE' THEN s.pledge_pct_promoter END AS pledge_pct_promoter,
  CASE WHEN s.pledge_status <> 'UNAVAILABLE' THEN s.pledge_pct_equity END AS pledge_pct_equity,
  s.pledge_status IS NOT NULL AS seen
FROM (SELECT DISTINCT symbol, q.quarter_end FROM state, quarters q) g
LEFT JOIN state s ON s.symbol = g.symbol AND s.quarter_end = g.quarter_end""", "state", "quarters")
piece("traj_fill", """SELECT symbol, quarter_end, seen,
  COALESCE(promoter_holding_pct, LAG(promoter_holding_pct) OVER w) AS promoter_holding_pct,
  COALESCE(pledge_pct_promoter, LAG(pledge_pct_promoter) OVER w) AS pledge_pct_promoter,
  COALESCE(pledge_pct_equity, LAG(pledge_pct_equity) OVER w) AS pledge_pct_equity,
  COALESCE(submission_date, LAG(submission_date) OVER w) AS submission_date,
  COALESCE(pledge_status, LAG(pledge_status) OVER w) AS pledge_status
FROM traj_base WINDOW w AS (PARTITION BY symbol ORDER BY quarter_end)""", "traj_base")
piece("traj_step", """SELECT *, pledge_pct_promoter - LAG(pledge_pct_promoter) OVER w AS pledge_chg_1q,
  pledge_pct_promoter - LAG(pledge_pct_promoter, 2) OVER w AS pledge_chg_2q,
  MAX(pledge_pct_promoter) OVER (PARTITION BY symbol ORDER BY quarter_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS pledge_max_4q,
  SUM(CASE WHEN pledge_pct_promoter > prev THEN 0 ELSE 1 END) OVER w AS island
FROM (SELECT *, LAG(pledge_pct_promoter) OVER (PARTITION BY symbol ORDER BY quarter_end) AS prev FROM traj_fill) t
WINDOW w AS (PARTITION BY symbol ORDER BY quarter_end)""", "traj_fill")
piece("trajectory", """SELECT symbol, quarter_end, submission_date, pledge_status, promoter_holding_pct,
  pledge_pct_promoter, pledge_pct_equity, pledge_chg_1q, pledge_chg_2q,
  pledge_chg_1q - LAG(pledge_chg_1q) OVER (PARTITION BY symbol ORDER BY quarter_end) AS pledge_accel,
  CASE WHEN pledge_pct_promoter IS NOT NULL AND prev IS NOT NULL THEN
    CAST(SUM(CASE WHEN pledge_pct_promoter > prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY quarter_end) AS INT)
  END AS consecutive_rising_q, pledge_max_4q,
  CASE WHEN NOT seen AND pledge_status IS NOT NULL THEN 1 ELSE 0 END AS is_stale
FROM traj_step""", "traj_step")
piece("pit", """SELECT g.symbol, g.observation_date, g.quarter_end, t.submission_date,
  t.promoter_holding_pct, t.pledge_pct_promoter, t.pledge_pct_equity, t.pledge_chg_1q, t.pledge_chg_2q,
  t.pledge_accel, t.consecutive_rising_q, t.pledge_max_4q, t.pledge_status, t.is_stale
FROM grid g LEFT JOIN trajectory t
  ON t.symbol = g.symbol AND t.quarter_end = g.quarter_end
  AND NOT COALESCE(t.submission_date > g.observation_date, FALSE)""",
      "grid", "trajectory")
piece("bars", """SELECT *, adj_close / LAG(adj_close, 90) OVER w - 1 AS lagged_return,
  STDDEV_SAMP(log_return) OVER w90 AS sd, COUNT(log_return) OVER w90 AS n_sd,
  MAX(adj_close) OVER w60 AS top, COUNT(adj_close) OVER w60 AS n_top,
  QUANTILE_CONT(adj_close * volume, 0.5) OVER w90 AS mid, COUNT(volume) OVER w90 AS n_mid,
  MIN(adj_close) OVER f AS trough, COUNT(adj_close) OVER f AS n_ahead,
  COUNT(*) OVER (PARTITION BY symbol) AS n_bars
FROM (SELECT *, ROW_NUMBER() OVER w - 1 AS pos, LN(adj_close / LAG(adj_close) OVER w) AS log_return,
        adj_close / LAG(adj_close) OVER w - 1 AS bar_return, LAG(adj_close) OVER w AS prev_close
      FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) p
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date),
  w90 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW),
  w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""", "prices")
piece("breaks", "SELECT symbol, trade_date, pos AS break_pos, prev_close, adj_close AS close, bar_return FROM bars WHERE bar_return < -0.35e0", "bars")
piece("bench_ret", """SELECT trade_date, adj_close / LAG(adj_close, 90) OVER (ORDER BY trade_date) - 1 AS bench_return
FROM bench""", "bench")
piece("anchors", """SELECT g.symbol, g.quarter_end, g.observation_date, b.* EXCLUDE (symbol)
FROM grid g ASOF LEFT JOIN bars b ON b.symbol = g.symbol AND b.trade_date <= g.observation_date""", "grid", "bars")
piece("market_raw", """SELECT a.symbol, a.observation_date, a.pos, a.adj_close AS entry_price,
  CASE WHEN n_bars >= 2 AND n_sd >= 45 THEN sd * SQRT(252e0) END AS volatility_90d,
  CASE WHEN n_bars >= 2 AND n_top >= 2 THEN a.adj_close / top - 1 END AS trailing_dd_60d,
  lagged_return AS return_90d, lagged_return - bench_return AS rel_return_90d,
  CASE WHEN n_bars >= 2 AND n_mid >= 45 AND mid > 0 THEN LN(mid) END AS log_turnover_90d,
  CASE WHEN n_ahead = 20 THEN trough / a.adj_close - 1 END AS fwd_raw
FROM anchors a ASOF LEFT JOIN bench_ret r ON r.trade_date <= a.observation_date""", "anchors", "bench_ret")
piece("break_gap", """SELECT m.symbol, m.observation_date, MIN(m.pos - k.break_pos) FILTER (k.break_pos <= m.pos) AS gap_back,
  MIN(k.break_pos - m.pos) FILTER (k.break_pos > m.pos) AS gap_ahead
FROM market_raw m JOIN breaks k ON k.symbol = m.symbol GROUP BY 1, 2""", "market_raw", "breaks")
piece("market", """SELECT m.symbol, m.observation_date, pos, entry_price,
  CASE WHEN COALESCE(gap_back > 90, TRUE) THEN volatility_90d END AS volatility_90d,
  CASE WHEN COALESCE(gap_back > 60, TRUE) THEN trailing_dd_60d END AS trailing_dd_60d,
  CASE WHEN COALESCE(gap_back > 90, TRUE) THEN return_90d END AS return_90d,
  CASE WHEN COALESCE(gap_back > 90, TRUE) THEN rel_return_90d END AS rel_return_90d,
  CASE WHEN COALESCE(gap_back > 90, TRUE) THEN log_turnover_90d END AS log_turnover_90d,
  CASE WHEN COALESCE(gap_ahead > 20, TRUE) THEN fwd_raw END AS fwd_max_drawdown
FROM market_raw m LEFT JOIN break_gap b ON b.symbol = m.symbol AND b.observation_date = m.observation_date""",
      "market_raw", "break_gap")
piece("material", "SELECT * FROM pledge_events WHERE COALESCE(pct_equity, 0) >= 0.01", "pledge_events")
piece("event_block", """SELECT g.symbol, g.observation_date,
  ROUND(COALESCE(SUM(pct_equity) FILTER (event_type = 'creation' AND event_date >= observation_date - 104), 0), 9) AS event_created_90d,
  ROUND(COALESCE(SUM(pct_equity) FILTER (event_type = 'release' AND event_date >= observation_date - 104), 0), 9) AS event_released_90d,
  CAST(COUNT(event_date) FILTER (event_date >= observation_date - 104) AS DOUBLE) AS event_count_90d,
  CAST(MIN(observation_date - 14 - event_date) AS DOUBLE) AS event_days_since,
  CAST(COUNT(event_date) FILTER (event_type = 'invocation' AND event_date >= observation_date - 379) AS DOUBLE) AS event_invocations_365d
FROM grid g LEFT JOIN material e ON e.symbol = g.symbol AND e.event_date <= g.observation_date - 14
GROUP BY 1, 2""", "grid", "material")
piece("panel", """SELECT p.symbol, p.observation_date, p.quarter_end,
  promoter_holding_pct, pledge_pct_promoter, pledge_pct_equity, pledge_chg_1q, pledge_chg_2q, pledge_accel,
  consecutive_rising_q, pledge_max_4q,
  volatility_90d, trailing_dd_60d, return_90d, rel_return_90d, log_turnover_90d,
  event_created_90d, event_released_90d, ROUND(event_created_90d - event_released_90d, 9) AS event_net_90d,
  event_count_90d, event_days_since, event_invocations_365d,
  COALESCE(is_stale, 0) AS is_stale, fwd_max_drawdown,
  CASE WHEN fwd_max_drawdown <= -0.32e0 THEN 1 WHEN fwd_max_drawdown IS NOT NULL THEN 0 END AS label,
  CASE WHEN fwd_max_drawdown IS NOT NULL THEN 1 ELSE 0 END AS label_is_valid
FROM pit p JOIN market m ON m.symbol = p.symbol AND m.observation_date = p.observation_date
JOIN event_block e ON e.symbol = p.symbol AND e.observation_date = p.observation_date""", "pit", "market", "event_block")
