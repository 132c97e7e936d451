"""Views that give the driver's tables the shape of the data model.

Each text is the common subset of Spark SQL and DuckDB, so operators and their checks read the very
same rows. Symbol = supplier. Every view is reduced to one row per key before anything is ordered.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions import scalars
from pitpanel.session import dealt
from pitpanel.settings import Settings, Windows

FIRST_QUARTER, LAST_QUARTER = dt.date(1995, 3, 31), dt.date(2001, 12, 31)
STUDY = Settings(windows=Windows(horizon_bars=20, threshold=-0.32))

PRICES = """
SELECT symbol, trade_date, volume,
       AVG(raw) OVER (PARTITION BY symbol ORDER BY trade_date
                      ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adj_close
FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
             SUM(l_extendedprice) / SUM(l_quantity) AS raw, SUM(l_quantity) AS volume
      FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) d"""

BENCHMARK = """
SELECT trade_date, AVG(raw) OVER (ORDER BY trade_date
       ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adj_close
FROM (SELECT CAST(l_shipdate AS DATE) AS trade_date, SUM(l_extendedprice) / SUM(l_quantity) AS raw
      FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)) d"""

# Every line is a filing. One symbol in three files half-yearly, which leaves gaps between its quarters; how late a
# quarter's filings come depends on symbol and quarter, so some quarters have none in time.
FILINGS = """
SELECT symbol, filing_id, line_no, quarter_end, quarter_end + lag_days AS submission_date,
       l_quantity * 2e0 AS promoter_holding_pct, ROUND(l_discount * 1e3, 6) AS pledge_pct_promoter,
       ROUND(l_discount * l_quantity * 2e1, 6) AS pledge_pct_equity,
       CASE WHEN l_tax > 0.075e0 THEN 'UNAVAILABLE' WHEN l_discount = 0e0 THEN 'NO_PLEDGE'
            ELSE 'PLEDGE_PRESENT' END AS pledge_status
FROM (SELECT l_suppkey AS symbol, l_orderkey AS filing_id, l_linenumber AS line_no,
             CAST(LAST_DAY(CAST(DATE_TRUNC('quarter', CASE WHEN l_suppkey % 3 = 0 AND QUARTER(l_shipdate) IN (1, 3)
                  THEN l_shipdate + INTERVAL 3 MONTH ELSE l_shipdate END) + INTERVAL 2 MONTH AS DATE)) AS DATE) AS quarter_end,
             CAST(1 + (l_suppkey * 13 + YEAR(l_shipdate) * 5 + QUARTER(l_shipdate) * 17) % 38 + l_linenumber % 3 AS INT) AS lag_days,
             l_quantity, l_discount, l_tax
      FROM {lineitem}) f"""

# What tells filings apart that repeat an (order, line): with these the order of a symbol's filings is total, up to equal rows.
FILING_ORDER = ("filing_id", "line_no", "promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity", "pledge_status")

EVENTS = """
SELECT l_orderkey * 10 + l_linenumber AS event_id, l_suppkey AS symbol,
       CAST(l_shipdate AS DATE) AS event_date,
       CASE l_returnflag WHEN 'A' THEN 'creation' WHEN 'R' THEN 'release' ELSE 'invocation' END AS event_type,
       l_tax AS pct_equity, l_quantity AS shares
FROM {lineitem}"""

OOF = """
SELECT symbol, observation_date, label, (k * 37 % 101) / 101e0 AS p_null,
       0.7e0 * ((k * 37 % 101) / 101e0) + 0.3e0 * label AS p_full
FROM (SELECT l_suppkey AS symbol,
             CAST(LAST_DAY(CAST(DATE_TRUNC('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS DATE) AS observation_date,
             MIN(l_orderkey) AS k, CASE WHEN CAST(SUM(l_quantity) AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS label
      FROM {lineitem} GROUP BY 1, 2) g"""

# Runs: one per (month of order, model, experiment); the run with most orders is active.
_RUN_ORDERS = """SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS order_date, model_name, experiment,
       CONCAT(CAST(YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS STRING), 'T0000_', model_name, '_', experiment) AS run_id
FROM (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'logreg' WHEN o_orderpriority = '3-MEDIUM' THEN 'randomforest'
             ELSE 'xgboost' END AS model_name,
             CASE o_orderstatus WHEN 'F' THEN 'expB_full' WHEN 'O' THEN 'exp0_null' ELSE 'expA_pledge' END AS experiment
      FROM {orders}) x"""

RUNS = """SELECT run_id, model_name, experiment, MIN(order_date) AS created_at, COUNT(*) AS n_train_rows,
       CAST(COUNT(DISTINCT order_date) AS INT) AS n_folds,
       CASE WHEN ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, run_id) = 1 THEN 1 ELSE 0 END AS is_active
FROM (""" + _RUN_ORDERS + """) r GROUP BY run_id, model_name, experiment"""

METRICS = """SELECT run_id, -1 AS fold, 'within_quarter_auc' AS metric_name, SQRT(AVG(o_totalprice) / 1e6) AS metric_value FROM (""" + _RUN_ORDERS + """) r GROUP BY run_id
UNION ALL SELECT run_id, -1, 'pr_auc', MIN(o_totalprice) / 1e6 FROM (""" + _RUN_ORDERS + """) r GROUP BY run_id
UNION ALL SELECT run_id, CAST(o_custkey % 3 AS INT), 'within_quarter_auc', SQRT(AVG(o_totalprice) / 1e6) FROM (""" + _RUN_ORDERS + """) r GROUP BY run_id, CAST(o_custkey % 3 AS INT)"""

# One row per (order, line): the raw table repeats some line numbers.
_LINES = """SELECT l_orderkey, l_linenumber, MIN(l_suppkey) AS l_suppkey, MIN(l_shipdate) AS l_shipdate, MIN(l_discount) AS l_discount,
       MIN(l_tax) AS l_tax, MIN(l_quantity) AS l_quantity, MIN(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

PREDICTIONS = """SELECT l_orderkey * 10 + l_linenumber AS prediction_id, run_id, l_suppkey AS symbol,
       CAST(LAST_DAY(CAST(DATE_TRUNC('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS DATE) AS observation_date,
       l_discount * 1e1 AS probability, CASE WHEN l_returnflag = 'A' THEN 'api' ELSE 'backtest' END AS source
FROM (""" + _LINES + """) l JOIN (""" + _RUN_ORDERS + """) r ON r.o_orderkey = l_orderkey"""

EXPLANATIONS = """SELECT l_orderkey * 10 + l_linenumber AS prediction_id, 'volatility_90d' AS feature_name,
       l_quantity / 1e2 AS feature_value, l_discount - 0.05e0 AS shap_value FROM (""" + _LINES + """) l
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'pledge_pct_promoter', l_quantity, l_tax - 0.04e0 FROM (""" + _LINES + """) l
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'pledge_pct_promoter_missing', CAST(NULL AS DOUBLE), (l_tax - l_discount) / 4e0 FROM (""" + _LINES + """) l
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'pledge_chg_1q', l_quantity - 2.5e1, l_quantity / 1e3 - 0.025e0 FROM (""" + _LINES + """) l"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders") if "{" + t + "}" in text}
    return spark.sql(text, **used)


def runs(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, RUNS)


def run_metrics(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, METRICS)


def predictions(spark, sf_dir) -> DataFrame:
    """Lines lie by order from the start, so that neither their reduction nor the join with orders moves them again."""
    return spark.sql(PREDICTIONS, lineitem=dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"), orders=table(spark, sf_dir, "orders"))


def lines(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, _LINES)


def explanations(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, EXPLANATIONS)


def prices(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, PRICES)


def benchmark(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, BENCHMARK)


def filings(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, FILINGS)


def events(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, EVENTS)


def oof(spark, sf_dir) -> DataFrame:
    return _view(spark, sf_dir, OOF)


def long_oof(spark, sf_dir) -> DataFrame:
    """Both experiments as rows: (experiment, symbol, observation_date, label, probability)."""
    return oof(spark, sf_dir).unpivot(
        ["symbol", "observation_date", "label"], ["p_null", "p_full"], "experiment", "probability"
    ).withColumn("experiment", F.when(F.col("experiment") == "p_null", "exp0_null").otherwise("expB_full"))


def companies(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("industry"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey", "left").select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("company_name"), "industry",
        F.col("s_acctbal").alias("acctbal"), (F.col("s_acctbal") >= 0).cast("int").alias("in_universe"))


def symbols(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))


def quarter_array():
    """The study's quarter ends as an array column."""
    return scalars.quarter_ends(F.lit(FIRST_QUARTER), F.lit(LAST_QUARTER))


def quarters(spark) -> DataFrame:
    """The study's quarter ends as rows: a calendar, so its size does not depend on the data."""
    return spark.range(1).select(F.explode(quarter_array()).alias("quarter_end"))
