"""Queries over stored tables: scans, merges, deletes, set operations, counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators import merge, runs as run_ops
from pitpanel.operators.stored import PartitionedTable, VersionedTable
from pitpanel.registered.base import compose, piece, query, r
from pitpanel.registered.panels import panel, tidy
from pitpanel.schemas import TABLES
from pitpanel.session import scratch_path
from pitpanel.settings import EXPERIMENTS
from pitpanel.sources import adapters as src, tables as scans



def stored(spark, df, name):
    """Write rows as one of the model's tables into a fresh root, with the declared types."""
    root = scratch_path(spark, "tables")
    schema = TABLES[name]
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(f"{root}/{name}")
    return root


# Scans ---------------------------------------------------------------------------------------

@query("scan_table", f"""SELECT CAST(symbol AS VARCHAR) AS symbol, trade_date, {r('adj_close', 6)}, volume FROM prices""", "prices")
def scan_table(spark, sf):
    root = stored(spark, src.prices(spark, sf), "prices")
    scans.scan_table(spark, root, "explanations").schema  # a table never written still has columns
    return scans.scan_table(spark, root, "prices").withColumn("adj_close", fx.rounded(F.col("adj_close"), 6))


@query("scan_keyed_filters", """SELECT run_id, model_name, experiment, created_at, n_train_rows, is_active FROM runs
WHERE experiment = 'expB_full' AND model_name = 'xgboost'""", "runs")
def scan_keyed_filters(spark, sf):
    out = scans.filtered(src.runs(spark, sf), [F.desc("created_at"), F.col("run_id")],
                         experiment="expB_full", model_name="xgboost", is_active=None)
    return out.select("run_id", "model_name", "experiment", "created_at", "n_train_rows", "is_active")


@query("scan_distinct_dates", """SELECT DISTINCT observation_date, label_is_valid = 1 AS labelled FROM panel""", "panel")
def scan_distinct_dates(spark, sf):
    frame = panel(spark, sf, ["observation_date", "label_is_valid"])
    every = scans.distinct_dates(frame, "observation_date").withColumn("labelled", F.lit(False))
    known = scans.distinct_dates(frame, "observation_date", valid_only=True).withColumn("labelled", F.lit(True))
    void = frame.where(F.col("label_is_valid") == 0).select("observation_date").distinct()
    return every.join(void, "observation_date", "left_semi").unionByName(known).orderBy("observation_date")


@query("scan_prices_filtered", f"""SELECT symbol, trade_date, {r('adj_close', 6)}, volume FROM prices
WHERE symbol IN (1, 3, 5, 7) AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", "prices")
def scan_prices_filtered(spark, sf):
    out = scans.by_symbols_and_dates(src.prices(spark, sf), "trade_date", [1, 3, 5, 7],
                                     dt.date(1996, 1, 1), dt.date(1999, 12, 31))
    return out.withColumn("adj_close", fx.rounded(F.col("adj_close"), 6))


_PAGE = "prediction_id, run_id, symbol, observation_date, ROUND(probability, 9) + 0e0 AS probability, source"


@query("scan_predictions_page", f"""SELECT {_PAGE} FROM predictions WHERE source = 'backtest' AND symbol = 7
ORDER BY observation_date DESC, probability DESC, symbol, prediction_id LIMIT 50 OFFSET 20""", "predictions")
def scan_predictions_page(spark, sf):
    return tidy(scans.predictions_page(src.predictions(spark, sf), 50, 20, source="backtest", symbol=7))


@query("page_with_total", f"""SELECT {_PAGE}, (SELECT COUNT(*) FROM predictions WHERE source = 'api') AS total FROM predictions
WHERE source = 'api' ORDER BY observation_date DESC, probability DESC, symbol, prediction_id LIMIT 900 OFFSET 100""", "predictions")
def page_with_total(spark, sf):
    return tidy(scans.page_with_total(src.predictions(spark, sf), 900, 100, source="api"))


_D = EXPERIMENTS[0].features


@query("scan_panel_experiment", f"""SELECT symbol, observation_date, quarter_end, {r('volatility_90d')}, {r('log_turnover_90d')},
is_stale, {r('fwd_max_drawdown')}, label, label_is_valid FROM panel WHERE label_is_valid = 1""", "panel")
def scan_panel_experiment(spark, sf):
    return tidy(scans.panel_for(panel(spark, sf), list(EXPERIMENTS[0].features)))


# Merges and deletes --------------------------------------------------------------------------

def ledger(spark, sf):
    """Orders as a filing ledger: id, key, status and the fields a status change may set."""
    o = src.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("submission_date"),
        F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "downloaded")
        .otherwise("pending").alias("status"),
        F.col("o_orderpriority").alias("local_path"), F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("date").alias("fetched_at"))


piece("ledger", """SELECT o_orderkey AS filing_id, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS submission_date,
CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'downloaded' ELSE 'pending' END AS status,
o_orderpriority AS local_path, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS DATE) AS fetched_at FROM orders""")
piece("line_counts", """SELECT l_orderkey + 3 AS filing_id, CASE WHEN MAX(l_linenumber) = 1 THEN NULL ELSE MIN(l_returnflag) END AS status
FROM lineitem GROUP BY l_orderkey""")


def line_payload(spark, sf):
    """One change per order with lines, shifted so that some keys are new; single-line orders set NULL."""
    return src.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("n"), F.min("l_returnflag").alias("flag")).select(
        (F.col("l_orderkey") + 3).alias("filing_id"), F.when(F.col("n") != 1, F.col("flag")).alias("status"))


def _ledger_table(spark, sf):
    table = PartitionedTable(scratch_path(spark, "ledger"), {"bucket": "pmod(filing_id div 32, 8)"})
    table.create(ledger(spark, sf))
    return table


_LEDGER = "filing_id, symbol, submission_date, status, local_path"


@query("merge_update", """SELECT COALESCE(t.filing_id, p.filing_id) AS filing_id, t.symbol, t.submission_date,
CASE WHEN p.filing_id IS NOT NULL THEN p.status ELSE t.status END AS status, t.local_path
FROM ledger t FULL JOIN line_counts p ON p.filing_id = t.filing_id""", "ledger", "line_counts")
def merge_update(spark, sf):
    """The ledger is stored in buckets of filings; only those of the payload's keys are read and written."""
    table = _ledger_table(spark, sf)
    table.upsert(spark, line_payload(spark, sf), ["filing_id"])
    return table.rows(spark).select("filing_id", "symbol", "submission_date", "status", "local_path")


@query("merge_insert_only", f"""SELECT {_LEDGER} FROM ledger UNION ALL
SELECT filing_id, NULL, NULL, status, NULL FROM line_counts WHERE filing_id NOT IN (SELECT filing_id FROM ledger)""",
       "ledger", "line_counts")
def merge_insert_only(spark, sf):
    table = _ledger_table(spark, sf)
    table.insert_new(spark, line_payload(spark, sf), ["filing_id"])
    return table.rows(spark).select("filing_id", "symbol", "submission_date", "status", "local_path")


_NEWER = "SELECT symbol, MAX(event_date) AS event_date FROM pledge_events WHERE event_type = 'release' GROUP BY symbol HAVING COUNT(*) > 200"


@query("replace_by_key", f"""SELECT symbol, event_date, event_type, pct_equity FROM pledge_events WHERE symbol NOT IN (SELECT symbol FROM ({_NEWER}) n)
UNION ALL SELECT symbol, event_date, 'snapshot', NULL FROM ({_NEWER}) n""", "pledge_events")
def replace_by_key(spark, sf):
    events = src.events(spark, sf).select("symbol", "event_date", "event_type", "pct_equity")
    newest = events.where(F.col("event_type") == "release").groupBy("symbol").agg(
        F.max("event_date").alias("event_date"), F.count("*").alias("n")).where(F.col("n") > 200).select(
        "symbol", "event_date", F.lit("snapshot").alias("event_type"))
    table = PartitionedTable(scratch_path(spark, "events"), {"bucket": "pmod(symbol, 8)"})
    table.create(events)
    table.replace(spark, newest, "symbol")
    return table.rows(spark)


@query("dedupe_natural_key", """SELECT symbol, event_type, shares, event_id, pct_equity FROM (SELECT *,
ROW_NUMBER() OVER (PARTITION BY symbol, event_type, shares ORDER BY event_id) AS rn
FROM (SELECT symbol, NULLIF(event_type, 'release') AS event_type, shares, event_id, pct_equity FROM pledge_events) e) x WHERE rn = 1""",
       "pledge_events")
def dedupe_natural_key(spark, sf):
    events = src.events(spark, sf).select(
        "symbol", F.nullif("event_type", F.lit("release")).alias("event_type"), "shares", "event_id", "pct_equity")
    return merge.dedupe_first(events, ["symbol", "event_type", "shares"], "event_id")


@query("overwrite_table", compose(f"""SELECT CAST(symbol AS VARCHAR) AS symbol, observation_date, {r('volatility_90d')}, consecutive_rising_q, label,
label_is_valid FROM panel""", "panel"))
def overwrite_table(spark, sf):
    frame = panel(spark, sf)
    doubles = [f.name for f in frame.schema.fields if f.dataType.typeName() == "double"]
    clean = frame.select(*[fx.known(F.col(c)).alias(c) if c in doubles else F.col(c) for c in frame.columns])
    root = scratch_path(spark, "tables")
    typed = clean.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["panel"].fields])
    table = VersionedTable(f"{root}/panel")
    table.write(typed)
    table.write(table.read(spark, TABLES["panel"]))  # from the version it replaces
    return tidy(table.read(spark, TABLES["panel"]).select(
        "symbol", "observation_date", "volatility_90d", "consecutive_rising_q", "label", "label_is_valid"))


@query("append_predictions", """SELECT prediction_id, run_id, symbol, ROUND(probability, 9) + 0e0 AS probability, 'backtest' AS source
FROM predictions UNION ALL SELECT prediction_id, run_id, symbol, ROUND(probability, 9) + 0e0, source FROM predictions WHERE source = 'api'""",
       "predictions")
def append_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    rows = src.predictions(spark, sf)
    stamp = F.lit(dt.datetime(2002, 1, 1))
    merge.append_rows(merge.prepare_predictions(rows.drop("source"), stamp), path)
    merge.append_rows(merge.prepare_predictions(rows.where(F.col("source") == "api"), stamp).select(
        *spark.read.parquet(path).columns), path)
    return tidy(spark.read.parquet(path).select("prediction_id", "run_id", "symbol", "probability", "source"))


piece("fold_wide", """SELECT run_id, CAST(o_custkey % 3 AS INT) AS fold, SQRT(AVG(o_totalprice) / 1e6) AS auc, CASE WHEN COUNT(*) > 2 THEN MIN(o_totalprice) / 1e6 END AS brier
FROM (""" + src._RUN_ORDERS.format(orders="orders") + ") r GROUP BY 1, 2")


@query("append_metrics", f"""SELECT run_id, fold, 'auc' AS metric_name, {r('auc', 9, 'metric_value')} FROM fold_wide
UNION ALL SELECT run_id, fold, 'brier', {r('brier', 9, 'metric_value')} FROM fold_wide WHERE brier IS NOT NULL""", "fold_wide")
def append_metrics(spark, sf):
    wide = spark.sql(src._RUN_ORDERS, orders=src.table(spark, sf, "orders")).groupBy(
        "run_id", (F.col("o_custkey") % 3).cast("int").alias("fold")).agg(
        F.sqrt(F.avg("o_totalprice") / 1e6).alias("auc"),
        F.when(F.count("*") > 2, F.min("o_totalprice") / 1e6).alias("brier"))
    long = merge.metrics_long(wide, ["auc", "brier"])
    older = long.where("fold < 2 AND metric_name = 'auc'").withColumn("metric_value", F.lit(0.0))  # an earlier run's values
    return tidy(merge.merge_update(older, long, ["run_id", "fold", "metric_name"]))


@query("delete_scoped", """SELECT prediction_id, run_id, symbol, observation_date, source FROM predictions WHERE NOT
(run_id = (SELECT run_id FROM runs WHERE is_active = 1) AND observation_date = DATE '1998-12-31' AND source = 'backtest')""",
       "predictions", "runs")
def delete_scoped(spark, sf):
    """One slice of the active run, found by a one-row semi-join. Predictions lie by date, so one partition is read and written."""
    rows = src.predictions(spark, sf).select("prediction_id", "run_id", "symbol", "observation_date", "source")
    active = src.runs(spark, sf).where(F.col("is_active") == 1).select("run_id", F.lit(True).alias("__active"))
    table = PartitionedTable(scratch_path(spark, "predictions"), {"day": "observation_date"})
    table.create(rows)

    def kept(part):
        scope = (F.col("observation_date") == F.lit(dt.date(1998, 12, 31))) & (F.col("source") == "backtest")
        return merge.delete_where(part.join(F.broadcast(active), "run_id", "left"), F.col("__active") & scope).select(*rows.columns)

    table.delete(spark, spark.sql("SELECT DATE '1998-12-31' AS observation_date"), kept)
    return table.rows(spark).select(*rows.columns)


piece("sessions", """SELECT SPLIT_PART(run_id, '_', 1) AS session, COUNT(*) AS n_runs, MIN(created_at) AS started_at, MAX(is_active) AS has_active
FROM runs GROUP BY 1""", "runs")
piece("doomed", """SELECT session FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY session DESC) AS rn FROM sessions) s
WHERE rn > 3 AND has_active = 0""", "sessions")


@query("agg_sessions", "SELECT session, n_runs, started_at, has_active FROM sessions", "sessions")
def agg_sessions(spark, sf):
    return run_ops.sessions(src.runs(spark, sf))


@query("set_except_sessions", "SELECT session FROM doomed", "doomed")
def set_except_sessions(spark, sf):
    return run_ops.superseded_sessions(run_ops.sessions(src.runs(spark, sf)), keep=3)


def _cascade_tables(spark, sf):
    return {"model_runs": src.runs(spark, sf), "model_metrics": src.run_metrics(spark, sf),
            "predictions": src.predictions(spark, sf), "explanations": src.explanations(spark, sf)}


_GONE = "SELECT run_id FROM runs WHERE SPLIT_PART(run_id, '_', 1) IN (SELECT session FROM doomed)"


@query("delete_cascade", f"""SELECT 'model_runs' AS "table", COUNT(*) AS deleted FROM runs WHERE run_id IN ({_GONE})
UNION ALL SELECT 'model_metrics', COUNT(*) FROM run_metrics WHERE run_id IN ({_GONE})
UNION ALL SELECT 'predictions', COUNT(*) FROM predictions WHERE run_id IN ({_GONE})
UNION ALL SELECT 'explanations', COUNT(*) FROM explanations WHERE prediction_id IN (SELECT prediction_id FROM predictions WHERE run_id IN ({_GONE}))""",
       "doomed", "run_metrics", "predictions", "explanations")
def delete_cascade(spark, sf):
    doomed = run_ops.superseded_sessions(run_ops.sessions(src.runs(spark, sf)), keep=3)
    return merge.delete_sessions(_cascade_tables(spark, sf), doomed)[1]


@query("prune_runs", f"""SELECT 'model_runs' AS "table", COUNT(*) AS remaining FROM runs WHERE run_id NOT IN ({_GONE})
UNION ALL SELECT 'model_metrics', COUNT(*) FROM run_metrics WHERE run_id NOT IN ({_GONE})
UNION ALL SELECT 'predictions', COUNT(*) FROM predictions WHERE run_id NOT IN ({_GONE})
UNION ALL SELECT 'explanations', COUNT(*) FROM explanations WHERE prediction_id NOT IN (SELECT prediction_id FROM predictions WHERE run_id IN ({_GONE}))""",
       "doomed", "run_metrics", "predictions", "explanations")
def prune_runs(spark, sf):
    left = run_ops.prune_runs(_cascade_tables(spark, sf), keep=3)[0]
    return run_ops.table_counts(left).withColumnRenamed("n", "remaining")


@query("update_status", """SELECT l.filing_id, CASE WHEN c.filing_id IS NULL THEN status WHEN late THEN 'quarantined' ELSE 'downloaded' END AS status,
CASE WHEN late THEN 'late lines' END AS error_message, local_path,
CASE WHEN c.filing_id IS NOT NULL AND NOT late THEN DATE '2002-01-01' END AS fetched_at
FROM ledger l LEFT JOIN (SELECT l_orderkey AS filing_id, MAX(l_tax) > 0.07e0 AS late FROM lineitem GROUP BY 1) c ON c.filing_id = l.filing_id""",
       "ledger")
def update_status(spark, sf):
    late = F.max("l_tax") > 0.07
    changes = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("filing_id")).agg(
        F.when(late, "quarantined").otherwise("downloaded").alias("status"),
        F.when(late, "late lines").alias("error_message"))
    known = changes.join(ledger(spark, sf), "filing_id", "left_semi")
    table = _ledger_table(spark, sf)
    table.rewrite(spark, table.touched(known), lambda part: merge.update_status(part, known, F.lit(dt.date(2002, 1, 1))))
    out = table.rows(spark)
    return out.select("filing_id", "status", "error_message", "local_path", "fetched_at")


_SHORT = "SELECT symbol FROM prices GROUP BY symbol HAVING COUNT(*) < 520"


@query("update_flag_in_list", f"""SELECT symbol, company_name, CASE WHEN symbol IN ({_SHORT}) THEN 0 ELSE in_universe END AS in_universe
FROM companies""", "companies", "prices")
def update_flag_in_list(spark, sf):
    short = src.prices(spark, sf).groupBy("symbol").count().where(F.col("count") < 520)
    out = merge.set_flag_in_list(src.companies(spark, sf), short, "in_universe", 0)
    return out.select("symbol", "company_name", "in_universe")


@query("filter_min_bars", """SELECT c.symbol, COALESCE(n, 0) AS n_bars, CASE WHEN COALESCE(n, 0) < 530 THEN 0 ELSE in_universe END AS in_universe
FROM companies c LEFT JOIN (SELECT symbol, COUNT(*) AS n FROM prices GROUP BY 1) p ON p.symbol = c.symbol""", "companies", "prices")
def filter_min_bars(spark, sf):
    return run_ops.flag_short_history(src.companies(spark, sf), src.prices(spark, sf), min_bars=530).select(
        "symbol", "n_bars", "in_universe")


@query("set_single_active", """SELECT run_id, CASE WHEN run_id = (SELECT MAX(run_id) FROM runs WHERE model_name = 'logreg') THEN 1 ELSE 0 END AS is_active
FROM runs""", "runs")
def set_single_active(spark, sf):
    runs = src.runs(spark, sf)
    newest = runs.where(F.col("model_name") == "logreg").agg(F.max("run_id")).first()[0]
    return merge.set_single_active(runs, newest).select("run_id", "is_active")


@query("filter_active_run", "SELECT run_id, model_name, experiment, n_train_rows FROM runs WHERE is_active = 1", "runs")
def filter_active_run(spark, sf):
    return run_ops.require_active_run(src.runs(spark, sf)).select("run_id", "model_name", "experiment", "n_train_rows")


# Counts --------------------------------------------------------------------------------------

@query("agg_table_counts", """SELECT 'runs' AS "table", COUNT(*) AS n FROM runs UNION ALL SELECT 'metrics', COUNT(*) FROM run_metrics
UNION ALL SELECT 'predictions', COUNT(*) FROM predictions UNION ALL SELECT 'prices', COUNT(*) FROM prices
UNION ALL SELECT 'companies', COUNT(*) FROM companies""", "runs", "run_metrics", "predictions", "prices", "companies")
def agg_table_counts(spark, sf):
    return run_ops.table_counts({
        "runs": src.runs(spark, sf), "metrics": src.run_metrics(spark, sf), "predictions": src.predictions(spark, sf),
        "prices": src.prices(spark, sf), "companies": src.companies(spark, sf)})


@query("agg_status_counts", "SELECT status, COUNT(*) AS n FROM ledger GROUP BY 1", "ledger")
def agg_status_counts(spark, sf):
    return ledger(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("agg_event_type_counts", "SELECT event_type, COUNT(*) AS n FROM pledge_events GROUP BY 1", "pledge_events")
def agg_event_type_counts(spark, sf):
    return src.events(spark, sf).groupBy(fx.normalise_event(F.col("event_type")).alias("event_type")).agg(
        F.count("*").alias("n"))


@query("agg_universe_completeness", """SELECT symbol, n_quarters, MEDIAN(n_quarters) OVER () AS median_kept FROM (
SELECT symbol, COUNT(DISTINCT quarter_end) AS n_quarters FROM filings GROUP BY 1 HAVING COUNT(DISTINCT quarter_end) >= 12
ORDER BY n_quarters DESC, symbol LIMIT 300) k""", "filings")
def agg_universe_completeness(spark, sf):
    return run_ops.complete_universe(src.filings(spark, sf), min_quarters=12, target=300)


@query("join_runs_metrics", f"""SELECT r.run_id, model_name, experiment, {r('metric_value')} FROM runs r JOIN run_metrics m ON m.run_id = r.run_id
WHERE fold = -1 AND metric_name = 'within_quarter_auc'""", "runs", "run_metrics")
def join_runs_metrics(spark, sf):
    return tidy(run_ops.model_comparison(src.runs(spark, sf), src.run_metrics(spark, sf), "within_quarter_auc").select(
        "run_id", "model_name", "experiment", "metric_value"))


@query("agg_pivot_metrics", f"""SELECT run_id, {r("MAX(metric_value) FILTER (metric_name = 'within_quarter_auc')", 9, 'within_quarter_auc')},
{r("MAX(metric_value) FILTER (metric_name = 'pr_auc')", 9, 'pr_auc')} FROM run_metrics WHERE fold = -1 GROUP BY 1""", "run_metrics")
def agg_pivot_metrics(spark, sf):
    return tidy(run_ops.metrics_wide(src.run_metrics(spark, sf), ["within_quarter_auc", "pr_auc"]))


@query("comparison_table", f"""SELECT r.run_id, experiment, model_name AS model, n_folds AS folds,
{r("MAX(metric_value) FILTER (metric_name = 'within_quarter_auc')", 9, 'within_quarter_auc')},
{r("MAX(metric_value) FILTER (metric_name = 'pr_auc')", 9, 'pr_auc')}
FROM runs r LEFT JOIN run_metrics m ON m.run_id = r.run_id AND m.fold = -1 GROUP BY 1, 2, 3, 4""", "runs", "run_metrics")
def comparison_table(spark, sf):
    return tidy(run_ops.comparison_table(src.runs(spark, sf), src.run_metrics(spark, sf), ["within_quarter_auc", "pr_auc"]))


piece("session_auc", """SELECT SPLIT_PART(r.run_id, '_', 1) AS session, model_name, experiment, metric_value FROM runs r
JOIN run_metrics m ON m.run_id = r.run_id WHERE fold = -1 AND metric_name = 'within_quarter_auc'""", "runs", "run_metrics")
piece("model_deltas", """SELECT t.session, t.experiment, c.experiment AS baseline, t.model_name, t.metric_value - c.metric_value AS delta
FROM session_auc t JOIN session_auc c ON c.session = t.session AND c.model_name = t.model_name AND c.experiment = 'exp0_null'
WHERE t.experiment <> 'exp0_null'""", "session_auc")


@query("agg_median_delta", f"""SELECT session, experiment, baseline, {r('MEDIAN(delta)', 9, 'median_delta')},
{r("MEDIAN(CASE WHEN model_name <> 'xgboost' THEN delta END)", 9, 'clean_median_delta')}, COUNT(*) AS n_models,
COUNT(*) FILTER (delta > 0) AS n_positive, COUNT(*) FILTER (delta <= 0) AS n_negative FROM model_deltas GROUP BY 1, 2, 3""", "model_deltas")
def agg_median_delta(spark, sf):
    from pitpanel.registered.evaluation import pairs

    auc = run_ops.model_comparison(src.runs(spark, sf), src.run_metrics(spark, sf), "within_quarter_auc").withColumn(
        "session", fx.session_of(F.col("run_id")))
    return tidy(run_ops.median_delta(auc, pairs(spark), ["session"], tuned="xgboost"))


@query("select_best", f"""SELECT session, model_name, experiment, {r('metric_value')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session
ORDER BY CASE model_name WHEN 'logreg' THEN 0 WHEN 'random_forest' THEN 1 WHEN 'xgboost' THEN 2 ELSE 3 END, metric_value DESC, model_name) AS rn
FROM (SELECT *, MAX(metric_value) OVER (PARTITION BY session) AS best FROM session_auc WHERE experiment = 'expB_full') b
WHERE best - metric_value <= 0.02e0) x WHERE rn = 1""", "session_auc")
def select_best(spark, sf):
    auc = run_ops.model_comparison(src.runs(spark, sf), src.run_metrics(spark, sf), "within_quarter_auc").withColumn(
        "session", fx.session_of(F.col("run_id")))
    return tidy(run_ops.select_best(auc, ["session"], "expB_full", tolerance=0.02).select(
        "session", "model_name", "experiment", "metric_value"))


@query("latest_row_per_symbol", f"""SELECT symbol, observation_date, {r('volatility_90d')}, {r('pledge_pct_promoter')}, label_is_valid
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY observation_date DESC) AS rn FROM panel) p WHERE rn = 1""", "panel")
def latest_row_per_symbol(spark, sf):
    cols = ["symbol", "observation_date", "volatility_90d", "pledge_pct_promoter", "label_is_valid"]
    return tidy(run_ops.latest_per_key(panel(spark, sf, cols), ["symbol"], ["observation_date"]), cols)


# Sets ----------------------------------------------------------------------------------------

@query("set_union_folds", f"SELECT experiment, COUNT(*) AS n, {r('AVG(probability)', 9, 'mean_probability')} FROM long_oof GROUP BY 1", "long_oof")
def set_union_folds(spark, sf):
    oof = src.oof(spark, sf)
    parts = [oof.select(F.lit(e).alias("experiment"), "symbol", F.col(c).alias("probability"))
             for e, c in (("exp0_null", "p_null"), ("expB_full", "p_full"))]
    return tidy(parts[0].unionByName(parts[1]).groupBy("experiment").agg(
        F.count("*").alias("n"), F.avg("probability").alias("mean_probability")))


@query("set_except_dates", """SELECT observation_date FROM (SELECT DISTINCT observation_date FROM panel EXCEPT SELECT observation_date FROM panel WHERE label_is_valid = 1) e
UNION ALL SELECT quarter_end FROM quarters WHERE quarter_end NOT IN (SELECT quarter_end FROM qmap)""", "panel")
def set_except_dates(spark, sf):
    """Embargoed dates, and quarters without an observable date."""
    from pitpanel.operators.asof import observation_dates

    frame = panel(spark, sf, ["observation_date", "label_is_valid"])
    labelled = frame.where(F.col("label_is_valid") == 1).select("observation_date")
    embargoed = frame.select("observation_date").subtract(labelled)
    rolled = observation_dates(src.quarters(spark), src.benchmark(spark, sf))
    return embargoed.union(rolled.where(F.col("observation_date").isNull()).select("quarter_end"))


@query("set_intersect_dates", """SELECT trade_date FROM bench INTERSECT SELECT quarter_end FROM quarters""", "bench", "quarters")
def set_intersect_dates(spark, sf):
    return src.benchmark(spark, sf).select("trade_date").intersect(src.quarters(spark).select("quarter_end"))


_SETS = " UNION ALL ".join(
    f"SELECT '{e.name}' AS experiment, '{e.baseline}' AS baseline, '{','.join(f for f in e.features if f not in b.features)}' AS extra, "
    f"CAST({len([f for f in e.features if f not in b.features])} AS INT) AS n_extra"
    for e in EXPERIMENTS for b in EXPERIMENTS if b.name == e.baseline and e.name != b.name)


@query("set_feature_difference", f"SELECT s.*, r.n_runs FROM ({_SETS}) s JOIN (SELECT experiment, COUNT(*) AS n_runs FROM runs GROUP BY 1) r ON r.experiment = s.experiment", "runs")
def set_feature_difference(spark, sf):
    """Per experiment that has runs: the features it adds to its baseline."""
    counts = src.runs(spark, sf).groupBy("experiment").agg(F.count("*").alias("n_runs"))
    return run_ops.extra_features(spark, EXPERIMENTS).join(counts, "experiment")
