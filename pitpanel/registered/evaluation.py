"""Queries that judge rankings: AUC, curves, backtests, intervals, ceilings and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators import backtest, metrics, ordering, power, sensitivity
from pitpanel.registered.base import compose, piece, query, r
from pitpanel.registered.panels import panel, tidy
from pitpanel.session import materialise
from pitpanel.settings import ALL_FEATURES, EVENT_FEATURES, EXPERIMENTS
from pitpanel.sources import adapters as src

_KEY = "experiment, observation_date"
_BY = ["experiment", "observation_date"]


def sql_auc(source: str, keys: str, label: str = "label", score: str = "probability") -> str:
    return f"""SELECT {keys}, COUNT(*) AS n, CAST(SUM({label}) AS BIGINT) AS n_positive,
  CASE WHEN SUM({label}) > 0 AND SUM({label}) < COUNT(*) THEN
    (SUM(rk) FILTER ({label} = 1) - SUM({label}) * (SUM({label}) + 1) / 2e0) / (SUM({label}) * (COUNT(*) - SUM({label}))) END AS auc
FROM (SELECT *, RANK() OVER (PARTITION BY {keys} ORDER BY {score}) + (COUNT(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2e0 AS rk
      FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL) t GROUP BY {keys}"""


def sql_skip(source: str) -> str:
    return f"""SELECT * EXCLUDE (auc), n < 10 OR n_positive = 0 OR n_positive = n AS skipped,
  CASE WHEN n >= 10 AND n_positive > 0 AND n_positive < n THEN auc END AS auc,
  CASE WHEN n < 10 THEN 'too few rows' WHEN n_positive = 0 OR n_positive = n THEN 'single class' ELSE '' END AS reason
FROM {source}"""


piece("long_oof", """SELECT 'exp0_null' AS experiment, symbol, observation_date, label, p_null AS probability FROM oof
UNION ALL SELECT 'expB_full', symbol, observation_date, label, p_full FROM oof""", "oof")
piece("date_auc_raw", sql_auc("long_oof", _KEY), "long_oof")
piece("date_auc", sql_skip("date_auc_raw"), "date_auc_raw")
piece("docs", """SELECT d.doc_id AS symbol, lang AS observation_date, CAST(n_chars AS DOUBLE) AS probability, quality AS label
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL""")
piece("docs_auc_raw", sql_auc("docs", "observation_date"), "docs")
piece("docs_auc", sql_skip("docs_auc_raw"), "docs_auc_raw")


def docs(spark, sf):
    """Documents scored by length, labelled by quality, grouped by language: few and uneven groups."""
    scored = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("symbol"), F.col("lang").alias("observation_date"),
        F.col("n_chars").cast("double").alias("probability"))
    known = src.table(spark, sf, "labels").select(F.col("doc_id").alias("symbol"), F.col("quality").alias("label"))
    return backtest.join_labels(scored, known, ["symbol"])


@query("join_inner_labels", "SELECT symbol, observation_date, probability, label FROM docs", "docs")
def join_inner_labels(spark, sf):
    return docs(spark, sf).select("symbol", "observation_date", "probability", "label")


@query("auc_pooled", f"SELECT experiment, {r('auc', 9, 'pooled_auc')} FROM ({sql_auc('long_oof', 'experiment')}) a", "long_oof")
def auc_pooled(spark, sf):
    return tidy(metrics.pooled_auc(src.long_oof(spark, sf), ["experiment"]))


_AUC_COLS = f"n, n_positive, {r('auc')}, skipped, reason"


@query("auc_within_date", f"SELECT {_KEY}, {_AUC_COLS} FROM date_auc", "date_auc")
def auc_within_date(spark, sf):
    return tidy(metrics.within_date_auc(src.long_oof(spark, sf), ["experiment"]))


@query("auc_within_date_documents", f"SELECT observation_date, {_AUC_COLS} FROM docs_auc", "docs_auc")
def auc_within_date_documents(spark, sf):
    return tidy(metrics.within_date_auc(docs(spark, sf), []))


_SPREAD = """SELECT experiment, AVG(auc) AS within_quarter_auc, STDDEV_SAMP(auc) AS within_quarter_auc_std,
  MIN(auc) AS within_quarter_auc_min, MAX(auc) AS within_quarter_auc_max,
  COUNT(*) FILTER (NOT skipped) AS n_dates_scored, COUNT(*) FILTER (skipped) AS n_dates_skipped FROM date_auc GROUP BY 1"""
piece("auc_spread", _SPREAD, "date_auc")
_SPREAD_COLS = ", ".join(r(c) for c in ("within_quarter_auc", "within_quarter_auc_std", "within_quarter_auc_min",
                                        "within_quarter_auc_max")) + ", n_dates_scored, n_dates_skipped"


@query("agg_fold_spread", f"""SELECT experiment, {_SPREAD_COLS},
ROUND((SELECT AVG(auc) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment ORDER BY observation_date) - 1 AS fold
  FROM date_auc WHERE NOT skipped) f WHERE fold <> 1 AND f.experiment = s.experiment), 9) + 0e0 AS within_quarter_auc_ex_search_fold
FROM auc_spread s""", "auc_spread")
def agg_fold_spread(spark, sf):
    detail = metrics.within_date_auc(src.long_oof(spark, sf), ["experiment"])
    folds = ordering.positions(detail.where(~F.col("skipped")), ["experiment"], ["observation_date"], "fold", "k", buckets=1)
    clean = folds.groupBy("experiment").agg(
        F.avg(F.when(F.col("fold") - 1 != src.STUDY.search_fold, F.col("auc"))).alias("within_quarter_auc_ex_search_fold"))
    return tidy(metrics.auc_spread(detail, ["experiment"]).join(clean, "experiment", "left"))


piece("falling", """SELECT experiment, probability AS score, SUM(label) AS pos, COUNT(*) AS n,
  SUM(SUM(label)) OVER w AS tp, SUM(COUNT(*)) OVER w AS seen,
  SUM(SUM(label)) OVER (PARTITION BY experiment) AS p_all, SUM(COUNT(*)) OVER (PARTITION BY experiment) AS n_all
FROM long_oof GROUP BY experiment, probability WINDOW w AS (PARTITION BY experiment ORDER BY probability DESC)""", "long_oof")
piece("ap", "SELECT experiment, SUM(pos / p_all * (tp / seen)) AS pr_auc FROM falling GROUP BY 1", "falling")
piece("brier", """SELECT experiment, AVG((probability - label) * (probability - label)) AS brier,
  1 - AVG((probability - label) * (probability - label)) / (AVG(label) * (1 - AVG(label))) AS brier_skill_score
FROM long_oof GROUP BY 1""", "long_oof")
piece("at_k", """SELECT experiment, observation_date, MAX(n) AS n, AVG(label) FILTER (rn <= 20) AS precision_at_k, AVG(label) AS base_rate
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, observation_date ORDER BY probability DESC, symbol) AS rn,
        COUNT(*) OVER (PARTITION BY experiment, observation_date) AS n FROM long_oof) t GROUP BY 1, 2""", "long_oof")


@query("average_precision", f"SELECT experiment, {r('pr_auc')} FROM ap", "ap")
def average_precision(spark, sf):
    return tidy(metrics.average_precision(src.long_oof(spark, sf), ["experiment"]))


@query("brier_and_skill", f"SELECT experiment, {r('brier')}, {r('brier_skill_score')} FROM brier", "brier")
def brier_and_skill(spark, sf):
    return tidy(metrics.brier(src.long_oof(spark, sf), ["experiment"]))


@query("precision_at_k", f"SELECT experiment, observation_date, n, {r('precision_at_k')}, {r('base_rate')} FROM at_k", "at_k")
def precision_at_k(spark, sf):
    return tidy(metrics.precision_at_k(src.long_oof(spark, sf), _BY, 20))


@query("win_topk_per_group", """SELECT experiment, observation_date, symbol, ROUND(probability, 9) + 0e0 AS probability,
CAST(rn AS INT) AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, observation_date
ORDER BY probability DESC, symbol) AS rn FROM long_oof) t WHERE rn <= 20""", "long_oof")
def win_topk_per_group(spark, sf):
    best = ordering.top_k(src.long_oof(spark, sf), _BY, [F.desc("probability"), F.col("symbol")], 20)
    return tidy(best.select("experiment", "observation_date", "symbol", "probability", "position"))


@query("evaluate_all", f"""SELECT s.experiment, {_SPREAD_COLS}, {r('a.auc', 9, 'pooled_auc')}, {r('pr_auc')},
{r('b.base_rate', 9, 'base_rate')}, {r('k.p', 9, 'precision_at_20')}, {r('brier')}, {r('brier_skill_score')}
FROM auc_spread s JOIN ap ON ap.experiment = s.experiment JOIN brier ON brier.experiment = s.experiment
JOIN ({sql_auc('long_oof', 'experiment')}) a ON a.experiment = s.experiment
JOIN (SELECT experiment, AVG(label) AS base_rate FROM long_oof GROUP BY 1) b ON b.experiment = s.experiment
JOIN (SELECT experiment, AVG(precision_at_k) AS p FROM at_k GROUP BY 1) k ON k.experiment = s.experiment""",
       "auc_spread", "ap", "brier", "at_k")
def evaluate_all(spark, sf):
    return tidy(metrics.evaluate_all(src.long_oof(spark, sf), ["experiment"]))


@query("roc_points", f"""SELECT experiment, {r('score', 9, 'threshold')}, {r('(seen - tp) / (n_all - p_all)', 9, 'fpr')},
{r('tp / p_all', 9, 'tpr')} FROM falling UNION ALL SELECT DISTINCT experiment, NULL, 0e0, 0e0 FROM long_oof""", "falling")
def roc_points(spark, sf):
    return tidy(metrics.roc_points(src.long_oof(spark, sf), ["experiment"]))


@query("pr_points", f"""SELECT experiment, {r('score', 9, 'threshold')}, {r('tp / seen', 9, 'precision')},
{r('tp / p_all', 9, 'recall')} FROM falling UNION ALL SELECT DISTINCT experiment, NULL, 1e0, 0e0 FROM long_oof""", "falling")
def pr_points(spark, sf):
    return tidy(metrics.pr_points(src.long_oof(spark, sf), ["experiment"]))


_EDGES = ", ".join(f"QUANTILE_CONT(probability, {i / 10}) AS e{i}" for i in range(1, 10))
_SLOT = " + ".join(f"CAST(e{i} < probability AS INT)" for i in range(1, 10))


@query("calibration_bins", f"""SELECT o.experiment, CAST({_SLOT} AS INT) AS bin, COUNT(*) AS n,
{r('AVG(probability)', 9, 'mean_probability')}, {r('AVG(label)', 9, 'event_rate')}
FROM long_oof o JOIN (SELECT experiment, {_EDGES} FROM long_oof GROUP BY 1) c ON c.experiment = o.experiment GROUP BY 1, 2""",
       "long_oof")
def calibration_bins(spark, sf):
    return tidy(metrics.calibration_bins(src.long_oof(spark, sf), ["experiment"]))


# Backtest ------------------------------------------------------------------------------------

piece("banded", """SELECT *, CAST(LEAST(GREATEST(CEIL(CAST(ROW_NUMBER() OVER w AS DOUBLE) / COUNT(*) OVER g * 5), 1), 5) AS INT) AS quintile
FROM long_oof WINDOW w AS (PARTITION BY experiment, observation_date ORDER BY probability, symbol),
g AS (PARTITION BY experiment, observation_date)""", "long_oof")
piece("quintiles", """SELECT experiment, observation_date, quintile, COUNT(*) AS n_companies, CAST(SUM(label) AS BIGINT) AS n_events,
AVG(label) AS event_rate FROM banded GROUP BY 1, 2, 3""", "banded")
piece("pooled", """SELECT experiment, quintile, CAST(SUM(n_companies) AS BIGINT) AS n_companies, CAST(SUM(n_events) AS BIGINT) AS n_events,
SUM(n_events) / SUM(n_companies) AS event_rate FROM quintiles GROUP BY 1, 2""", "quintiles")


def sql_separation(source: str, keys: str) -> str:
    rates = ", ".join(f"MAX(event_rate) FILTER (quintile = {q}) AS r{q}" for q in range(1, 6))
    return f"""SELECT {keys}, base_rate, r1 AS q1_event_rate, r5 AS q5_event_rate,
  CASE WHEN r1 > 0 THEN r5 / r1 END AS separation_ratio, r5 - r1 AS separation_diff,
  CASE WHEN base_rate > 0 THEN r5 / base_rate END AS lift_q5,
  COALESCE(r1 <= r2 AND r2 <= r3 AND r3 <= r4 AND r4 <= r5, FALSE) AS monotonic
FROM (SELECT {keys}, SUM(n_events) / SUM(n_companies) AS base_rate, {rates} FROM {source} GROUP BY {keys}) w"""


piece("sep_date", sql_separation("quintiles", _KEY), "quintiles")
piece("sep_pool", sql_separation("pooled", "experiment"), "pooled")
piece("bt_summary", """SELECT p.*, n_dates, n_dates_monotonic, n_dates_q5_beats_q1, ratio_median, ratio_min, ratio_max, n_dates_ratio_undefined
FROM sep_pool p JOIN (SELECT experiment, COUNT(*) AS n_dates, COUNT(*) FILTER (monotonic) AS n_dates_monotonic,
  COUNT(*) FILTER (separation_diff > 0) AS n_dates_q5_beats_q1, MEDIAN(separation_ratio) AS ratio_median,
  MIN(separation_ratio) AS ratio_min, MAX(separation_ratio) AS ratio_max,
  COUNT(*) FILTER (separation_ratio IS NULL) AS n_dates_ratio_undefined FROM sep_date GROUP BY 1) d ON d.experiment = p.experiment""",
      "sep_pool", "sep_date")
_SEP = ", ".join(r(c) for c in ("base_rate", "q1_event_rate", "q5_event_rate", "separation_ratio", "separation_diff", "lift_q5")) + ", monotonic"


def quintiles(spark, sf):
    return backtest.quintile_table(src.long_oof(spark, sf), ["experiment"])


@query("win_rank_groups", "SELECT experiment, observation_date, symbol, quintile FROM banded", "banded")
def win_rank_groups(spark, sf):
    out = metrics.rank_groups(src.long_oof(spark, sf), _BY, "probability", 5, out="quintile")
    return out.select(*_BY, "symbol", "quintile")


@query("agg_quintile_rates", f"SELECT {_KEY}, quintile, n_companies, n_events, {r('event_rate')} FROM quintiles", "quintiles")
def agg_quintile_rates(spark, sf):
    return tidy(quintiles(spark, sf))


@query("agg_quintile_pooled", f"SELECT experiment, quintile, n_companies, n_events, {r('event_rate')} FROM pooled", "pooled")
def agg_quintile_pooled(spark, sf):
    return tidy(backtest.pool_quintiles(quintiles(spark, sf), ["experiment"]))


@query("separation_by_date", f"SELECT {_KEY}, {_SEP} FROM sep_date", "sep_date")
def separation_by_date(spark, sf):
    return tidy(backtest.separation(quintiles(spark, sf), _BY))


@query("backtest_summary", f"""SELECT experiment, {_SEP}, n_dates, n_dates_monotonic, n_dates_q5_beats_q1,
{r('ratio_median')}, {r('ratio_min')}, {r('ratio_max')}, n_dates_ratio_undefined FROM bt_summary""", "bt_summary")
def backtest_summary(spark, sf):
    return tidy(backtest.summary(quintiles(spark, sf), ["experiment"]))


_MEASURES = " UNION ALL ".join(
    f"SELECT {i} AS position, '{t}' AS measure, experiment, CAST({c} AS DOUBLE) AS v FROM bt_summary"
    for i, (c, t) in enumerate(backtest.COMPARED))


@query("backtest_compare", f"""SELECT position, measure, {r("MAX(v) FILTER (experiment = 'expB_full')", 9, 'headline')},
{r("MAX(v) FILTER (experiment = 'exp0_null')", 9, 'null_model')} FROM ({_MEASURES}) m GROUP BY 1, 2""", "bt_summary")
def backtest_compare(spark, sf):
    both = backtest.summary(quintiles(spark, sf), ["experiment"])
    return tidy(backtest.compare(both, "experiment", "expB_full", "exp0_null"))


@query("win_pct_rank_avg", """SELECT experiment, observation_date, ROUND(probability, 9) + 0e0 AS score, COUNT(*) AS n,
ROUND(MAX(rk / c), 9) + 0e0 AS pct_rank FROM (SELECT *, COUNT(*) OVER (PARTITION BY experiment, observation_date) AS c,
RANK() OVER (PARTITION BY experiment, observation_date ORDER BY probability)
+ (COUNT(*) OVER (PARTITION BY experiment, observation_date, probability) - 1) / 2e0 AS rk FROM long_oof) t
GROUP BY experiment, observation_date, probability""", "long_oof")
def win_pct_rank_avg(spark, sf):
    counts = metrics.score_counts(src.long_oof(spark, sf), _BY)
    return tidy(metrics.percent_rank_avg(counts, _BY).select(*_BY, "score", "n", "pct_rank"))


# Intervals -----------------------------------------------------------------------------------

piece("model_oof", """SELECT 'logreg' AS model, 'exp0_null' AS experiment, symbol, observation_date, label, p_null AS probability FROM oof
UNION ALL SELECT 'logreg', 'expB_full', symbol, observation_date, label, p_full FROM oof
UNION ALL SELECT 'logreg', 'expC_events', symbol, observation_date, label, 0.95e0 * p_null + 0.05e0 * label FROM oof
UNION ALL SELECT 'xgboost', 'exp0_null', symbol, observation_date, label, p_null FROM oof
UNION ALL SELECT 'xgboost', 'expB_full', symbol, observation_date, label, 0.5e0 * p_null + 0.5e0 * p_full FROM oof
UNION ALL SELECT 'xgboost', 'expC_events', symbol, observation_date, label, p_null FROM oof""", "oof")
piece("model_auc_raw", sql_auc("model_oof", "model, experiment, observation_date"), "model_oof")
piece("model_auc", sql_skip("model_auc_raw"), "model_auc_raw")
piece("deltas", """SELECT t.model, t.experiment, c.experiment AS baseline, t.observation_date, t.auc - c.auc AS delta,
  ROW_NUMBER() OVER (PARTITION BY t.model, t.experiment ORDER BY t.observation_date) - 1 AS i,
  COUNT(*) OVER (PARTITION BY t.model, t.experiment) AS n
FROM model_auc t JOIN model_auc c ON c.model = t.model AND c.observation_date = t.observation_date
WHERE c.experiment = 'exp0_null' AND t.experiment <> 'exp0_null' AND t.auc IS NOT NULL AND c.auc IS NOT NULL""", "model_auc")
_DRAWS = 10_000
_HASH = "('0x' || SUBSTR(MD5(b || '-' || k || '-' || '42'), 1, 8))::BIGINT"
piece("resamples", f"""SELECT r.model, r.experiment, r.baseline, b, AVG(v.delta) AS m, STDDEV_SAMP(v.delta) AS s, MAX(r.n) AS n
FROM (SELECT model, experiment, baseline, n, b, k, {_HASH} % n AS pick
      FROM (SELECT DISTINCT model, experiment, baseline, n FROM deltas) c, generate_series(0, {_DRAWS - 1}) bs(b), generate_series(0, n - 1) ks(k)) r
JOIN deltas v ON v.model = r.model AND v.experiment = r.experiment AND v.i = r.pick GROUP BY 1, 2, 3, 4""", "deltas")
piece("center", """SELECT model, experiment, baseline, COUNT(*) AS n, AVG(delta) AS theta, STDDEV_SAMP(delta) / SQRT(COUNT(*)) AS std_error
FROM deltas GROUP BY 1, 2, 3""", "deltas")
piece("intervals", """SELECT c.*, CASE WHEN std_error <= 1e-12 THEN theta ELSE theta - hi * std_error END AS ci_low,
  CASE WHEN std_error <= 1e-12 THEN theta ELSE theta - lo * std_error END AS ci_high
FROM center c LEFT JOIN (SELECT model, experiment, QUANTILE_CONT(t, 0.975) AS hi, QUANTILE_CONT(t, 0.025) AS lo
  FROM (SELECT r.model, r.experiment, (m - theta) / (s / SQRT(r.n)) AS t FROM resamples r
        JOIN center c ON c.model = r.model AND c.experiment = r.experiment WHERE s / SQRT(r.n) > 1e-12) x GROUP BY 1, 2) q
  ON q.model = c.model AND q.experiment = c.experiment""", "center", "resamples")
_IDS = "model, experiment, baseline"


def model_oof(spark, sf):
    """Out-of-fold scores of two models and three experiments, derived from the two score columns."""
    null, full, label = F.col("p_null"), F.col("p_full"), F.col("label")
    scores = [("logreg", "exp0_null", null), ("logreg", "expB_full", full),
              ("logreg", "expC_events", 0.95 * null + 0.05 * label), ("xgboost", "exp0_null", null),
              ("xgboost", "expB_full", 0.5 * null + 0.5 * full), ("xgboost", "expC_events", null)]
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(e).alias("experiment"), p.alias("probability")) for m, e, p in scores]))
    return src.oof(spark, sf).select("symbol", "observation_date", "label", rows.alias("__s")).select(
        "__s.model", "__s.experiment", "symbol", "observation_date", "label", "__s.probability")


def pairs(spark):
    """Experiment and its own baseline: configuration, one row per experiment."""
    return spark.createDataFrame([(e.name, e.baseline) for e in EXPERIMENTS if e.name != e.baseline],
                                 "experiment string, baseline string")


def deltas(spark, sf):
    detail = metrics.within_date_auc(model_oof(spark, sf), ["model", "experiment"])
    both = power.paired_dates(detail, pairs(spark), ["model"])
    return both.withColumn("delta", F.col("treatment") - F.col("control"))


@query("join_paired_dates", f"""SELECT t.model, t.experiment, 'exp0_null' AS baseline, t.observation_date, {r('t.auc', 9, 'treatment')},
{r('c.auc', 9, 'control')}, {r('t.auc - c.auc', 9, 'delta')} FROM model_auc t JOIN model_auc c ON c.model = t.model
AND c.observation_date = t.observation_date AND c.experiment = 'exp0_null' WHERE t.experiment <> 'exp0_null'
AND (t.auc IS NOT NULL OR c.auc IS NOT NULL)""", "model_auc")
def join_paired_dates(spark, sf):
    present = deltas(spark, sf).where(F.col("experiment").isin("expB_full", "expC_events"))
    return tidy(present)


@query("bootstrap_t_interval", f"""SELECT {_IDS}, n, {r('theta')}, {r('std_error')}, {r('ci_low', 8)}, {r('ci_high', 8)} FROM intervals""", "intervals")
def bootstrap_t_interval(spark, sf):
    shared = deltas(spark, sf).where(F.col("delta").isNotNull())
    out = power.bootstrap_t_interval(shared, ["model", "experiment", "baseline"], "observation_date", "delta", n_bootstrap=_DRAWS)
    out = tidy(out)
    return out.withColumns({c: fx.rounded(F.col(c), 8) for c in ("ci_low", "ci_high")})


@query("bootstrap_percentile_interval", f"""SELECT {_IDS}, {r('QUANTILE_CONT(m, 0.025)', 9, 'ci_low')},
{r('QUANTILE_CONT(m, 0.975)', 9, 'ci_high')} FROM resamples GROUP BY 1, 2, 3""", "resamples")
def bootstrap_percentile_interval(spark, sf):
    shared = deltas(spark, sf).where(F.col("delta").isNotNull())
    return tidy(power.bootstrap_percentile_interval(
        shared, ["model", "experiment", "baseline"], "observation_date", "delta", n_bootstrap=_DRAWS))


_VERDICT = """CASE WHEN ci_low IS NULL OR ci_high IS NULL THEN 'UNKNOWN' WHEN ci_low > 0 THEN 'POSITIVE'
WHEN ci_high < 0 THEN 'NEGATIVE' ELSE 'ZERO' END"""
piece("paired", f"""SELECT i.*, better AS dates_better, worse AS dates_worse, {_VERDICT} AS verdict FROM intervals i
JOIN (SELECT model, experiment, COUNT(*) FILTER (delta > 0) AS better, COUNT(*) FILTER (delta < 0) AS worse
      FROM deltas GROUP BY 1, 2) d ON d.model = i.model AND d.experiment = i.experiment""", "intervals")
_PAIRED = f"""n AS n_dates, {r('theta', 9, 'delta')}, {r('std_error', 9, 'sd')}, {r('ci_low', 8)}, {r('ci_high', 8)},
{r('(ci_high - ci_low) / 2', 8, 'half_width')}, dates_better, dates_worse, verdict"""
_PAIRED_OUT = ["n_dates", "delta", "sd", "ci_low", "ci_high", "half_width", "dates_better", "dates_worse", "verdict"]


def _eight(df):
    return df.withColumns({c: fx.rounded(F.col(c), 8) for c in ("ci_low", "ci_high", "half_width")})


@query("paired_delta", f"SELECT {_IDS}, {_PAIRED} FROM paired", "paired")
def paired_delta(spark, sf):
    detail = metrics.within_date_auc(model_oof(spark, sf), ["model", "experiment"])
    out = power.paired_delta(detail, pairs(spark), ["model"], n_bootstrap=_DRAWS).where(F.col("n_dates") > 0)
    return _eight(tidy(out, ["model", "experiment", "baseline", *_PAIRED_OUT]))


@query("agg_verdict_counts", "SELECT verdict, COUNT(*) AS n FROM paired GROUP BY 1", "paired")
def agg_verdict_counts(spark, sf):
    return paired_delta(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


# Ceilings: panel features say which rows a treatment can see.
_B_EXTRA = [f for f in EXPERIMENTS[2].features if f not in EXPERIMENTS[0].features]


def sql_any(columns: list[str]) -> str:
    return " OR ".join(f"COALESCE({c} <> 0, FALSE)" for c in columns)


piece("masks", f"""SELECT 'expB_full' AS experiment, symbol, quarter_end AS observation_date, {sql_any(_B_EXTRA)} AS visible FROM panel
UNION ALL SELECT 'expC_events', symbol, quarter_end, {sql_any(EVENT_FEATURES)} FROM panel""", "panel")
piece("seen_control", """SELECT c.model, m.experiment, c.experiment AS baseline, c.symbol, c.observation_date, c.label, c.probability,
  COALESCE(k.visible, FALSE) AS visible
FROM model_oof c JOIN (VALUES ('expB_full'), ('expC_events')) m(experiment) ON c.experiment = 'exp0_null'
LEFT JOIN masks k ON k.experiment = m.experiment AND k.symbol = c.symbol AND k.observation_date = c.observation_date""", "model_oof", "masks")
piece("pct", """SELECT *, (RANK() OVER (PARTITION BY model, experiment, observation_date ORDER BY probability)
 + (COUNT(*) OVER (PARTITION BY model, experiment, observation_date, probability) - 1) / 2e0)
 / COUNT(*) OVER (PARTITION BY model, experiment, observation_date) AS pr FROM seen_control""", "seen_control")
piece("moved", "SELECT *, CASE WHEN visible THEN pr + (label - 0.5e0) * 2 ELSE pr END AS moved FROM pct", "pct")
piece("oracle_raw", sql_auc("moved", "model, experiment, baseline, observation_date", score="moved"), "moved")
piece("base_raw", sql_auc("moved", "model, experiment, baseline, observation_date", score="pr"), "moved")
piece("ceilings", f"""SELECT c.*, b.auc AS baseline_auc, o.auc AS oracle_auc FROM
(SELECT {_IDS}, AVG(CAST(visible AS DOUBLE)) AS coverage, COUNT(*) FILTER (visible) AS rows_visible, COUNT(*) AS rows_total FROM seen_control GROUP BY 1, 2, 3) c
JOIN (SELECT {_IDS}, AVG(auc) AS auc FROM ({sql_skip('base_raw')}) x GROUP BY 1, 2, 3) b ON b.model = c.model AND b.experiment = c.experiment
JOIN (SELECT {_IDS}, AVG(auc) AS auc FROM ({sql_skip('oracle_raw')}) x GROUP BY 1, 2, 3) o ON o.model = c.model AND o.experiment = c.experiment""",
      "seen_control", "base_raw", "oracle_raw")
_CEIL = f"""{r('baseline_auc')}, {r('oracle_auc')}, {r('oracle_auc - baseline_auc', 9, 'ceiling')}, {r('coverage')},
rows_visible, rows_total, oracle_auc < 1 - 1e-9 AS ceiling_binding"""


def masks(spark, sf):
    wanted = ["symbol", "quarter_end", *ALL_FEATURES]
    frame = panel(spark, sf, wanted).withColumnRenamed("quarter_end", "observation_date")
    flags = F.explode(F.array(
        F.struct(F.lit("expB_full").alias("experiment"), power.any_feature(_B_EXTRA, frame.columns).alias("visible")),
        F.struct(F.lit("expC_events").alias("experiment"), power.any_feature(EVENT_FEATURES, frame.columns).alias("visible"))))
    return frame.select("symbol", "observation_date", flags.alias("__f")).select("symbol", "observation_date", "__f.*")


@query("filter_has_any_feature", "SELECT symbol, observation_date FROM masks WHERE experiment = 'expC_events' AND visible", "masks")
def filter_has_any_feature(spark, sf):
    frame = panel(spark, sf, ["symbol", "quarter_end", *EVENT_FEATURES])
    hit = power.any_feature([*EVENT_FEATURES, "no_such_feature"], frame.columns)
    return frame.where(hit).select("symbol", F.col("quarter_end").alias("observation_date"))


@query("join_key_not_position", """SELECT symbol, observation_date, visible FROM seen_control
WHERE model = 'logreg' AND experiment = 'expB_full'""", "seen_control")
def join_key_not_position(spark, sf):
    control = model_oof(spark, sf).where((F.col("model") == "logreg") & (F.col("experiment") == "exp0_null"))
    frame = panel(spark, sf, ["symbol", "quarter_end", *_B_EXTRA]).withColumnRenamed("quarter_end", "observation_date")
    seen = power.visible_rows(control, frame, _B_EXTRA, ["symbol", "observation_date"])
    return seen.select("symbol", "observation_date", "visible")


@query("oracle_ceiling", f"SELECT {_IDS}, {_CEIL} FROM ceilings", "ceilings")
def oracle_ceiling(spark, sf):
    present = pairs(spark).where(F.col("experiment").isin("expB_full", "expC_events"))
    seen = power.control_rows(model_oof(spark, sf), present, masks(spark, sf))
    return tidy(power.oracle_ceiling(seen, ["model", "experiment", "baseline"]))


@query("power_report", f"""SELECT p.model, p.experiment, p.baseline, {_PAIRED}, {_CEIL} FROM paired p
JOIN ceilings c ON c.model = p.model AND c.experiment = p.experiment""", "paired", "ceilings")
def power_report(spark, sf):
    present = pairs(spark).where(F.col("experiment").isin("expB_full", "expC_events"))
    out = power.power_report(model_oof(spark, sf), present, masks(spark, sf), n_bootstrap=_DRAWS)
    cols = ["model", "experiment", "baseline", *_PAIRED_OUT, "baseline_auc", "oracle_auc", "ceiling", "coverage",
            "rows_visible", "rows_total", "ceiling_binding"]
    return _eight(tidy(out, cols))


# Sensitivity ---------------------------------------------------------------------------------

piece("labelled", "SELECT * FROM panel WHERE label_is_valid = 1", "panel")
_CREATED = "COALESCE(SUM(pct_equity) FILTER (event_type = 'creation'), 0e0)"
_RELEASED = "COALESCE(SUM(pct_equity) FILTER (event_type = 'release'), 0e0)"
piece("win_feats", f"""SELECT p.symbol, p.observation_date, p.label, CAST(w AS INT) AS window_days,
  CAST(COUNT(e.event_date) AS DOUBLE) AS count, ROUND({_CREATED}, 9) AS created, ROUND({_CREATED} - {_RELEASED}, 9) AS net
FROM labelled p CROSS JOIN (VALUES (30), (90), (180), (365), (730)) v(w) LEFT JOIN material e ON e.symbol = p.symbol
  AND e.event_date BETWEEN p.observation_date - 14 - w AND p.observation_date - 14 GROUP BY 1, 2, 3, 4""", "labelled", "material")
piece("cut_feats", f"""SELECT p.symbol, p.observation_date, p.label, CAST(t AS DOUBLE) AS min_pct_equity,
  CAST(COUNT(e.event_date) AS DOUBLE) AS count, ROUND({_CREATED} - {_RELEASED}, 9) AS net
FROM labelled p CROSS JOIN (VALUES (0), (0.01), (0.1), (0.5)) v(t) LEFT JOIN pledge_events e ON e.symbol = p.symbol
  AND COALESCE(pct_equity, 0) >= CAST(t AS DOUBLE)
  AND e.event_date BETWEEN p.observation_date - 104 AND p.observation_date - 14 GROUP BY 1, 2, 3, 4""", "labelled", "pledge_events")


def sql_feature_auc(source: str, key: str, score: str) -> str:
    inner = sql_auc(source, f"{key}, observation_date", score=score)
    return f"SELECT {key}, AVG(auc) AS auc FROM ({sql_skip(f'({inner}) q')}) s GROUP BY 1"


@query("sweep_windows", f"""SELECT v.window_days, {r('v.coverage', 9, 'coverage')}, {r('a.auc', 9, 'count')}, {r('b.auc', 9, 'net')},
{r('c.auc', 9, 'created')}, v.window_days = 90 AS configured
FROM (SELECT window_days, AVG(CAST(count > 0 AS DOUBLE)) AS coverage FROM win_feats GROUP BY 1) v
JOIN ({sql_feature_auc('win_feats', 'window_days', 'count')}) a ON a.window_days = v.window_days
JOIN ({sql_feature_auc('win_feats', 'window_days', 'net')}) b ON b.window_days = v.window_days
JOIN ({sql_feature_auc('win_feats', 'window_days', 'created')}) c ON c.window_days = v.window_days""", "win_feats")
def sweep_windows(spark, sf):
    return tidy(sensitivity.window_sweep(src.events(spark, sf), labelled(spark, sf)))


def labelled(spark, sf, features=()):
    cols = ["symbol", "observation_date", "quarter_end", "label", "label_is_valid", *features]
    return materialise(panel(spark, sf, cols), "panel").where(F.col("label_is_valid") == 1)


@query("sweep_materiality", f"""SELECT v.min_pct_equity, {r('v.coverage', 9, 'coverage')}, {r('a.auc', 9, 'count_auc')},
{r('b.auc', 9, 'net_auc')}, events_kept, events_dropped, companies, v.min_pct_equity = 0.01e0 AS configured
FROM (SELECT min_pct_equity, AVG(CAST(count > 0 AS DOUBLE)) AS coverage FROM cut_feats GROUP BY 1) v
JOIN ({sql_feature_auc('cut_feats', 'min_pct_equity', 'count')}) a ON a.min_pct_equity = v.min_pct_equity
JOIN ({sql_feature_auc('cut_feats', 'min_pct_equity', 'net')}) b ON b.min_pct_equity = v.min_pct_equity
JOIN (SELECT CAST(t AS DOUBLE) AS t, COUNT(*) FILTER (COALESCE(pct_equity, 0) >= CAST(t AS DOUBLE)) AS events_kept,
  COUNT(*) FILTER (COALESCE(pct_equity, 0) < CAST(t AS DOUBLE)) AS events_dropped,
  COUNT(DISTINCT CASE WHEN COALESCE(pct_equity, 0) >= CAST(t AS DOUBLE) THEN symbol END) AS companies
  FROM pledge_events, (VALUES (0), (0.01), (0.1), (0.5)) x(t) GROUP BY 1) k ON k.t = v.min_pct_equity""", "cut_feats")
def sweep_materiality(spark, sf):
    return tidy(sensitivity.materiality_sweep(src.events(spark, sf), labelled(spark, sf)))


_LONG = " UNION ALL ".join(
    f"SELECT observation_date, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM labelled" for f in ALL_FEATURES)
piece("feature_long", _LONG, "labelled")
piece("feature_filled", "SELECT observation_date, label, feature, COALESCE(value, 0e0) AS value FROM feature_long", "feature_long")
piece("univariate", f"""SELECT a.feature, auc, 1 - auc AS auc_if_inverted, ABS(auc - 0.5e0) AS strength, coverage, nonzero
FROM ({sql_feature_auc('feature_filled', 'feature', 'value')}) a
JOIN (SELECT feature, AVG(CAST(value IS NOT NULL AS DOUBLE)) AS coverage,
  AVG(CAST(COALESCE(value, 0) <> 0 AS DOUBLE)) AS nonzero FROM feature_long GROUP BY 1) s ON s.feature = a.feature
WHERE auc IS NOT NULL""", "feature_filled")
_UNI = f"feature, {r('auc')}, {r('auc_if_inverted')}, {r('strength')}, {r('coverage')}, {r('nonzero')}"


@query("univariate_table", f"SELECT {_UNI} FROM univariate", "univariate")
def univariate_table(spark, sf):
    return tidy(sensitivity.univariate_table(labelled(spark, sf, ALL_FEATURES), ALL_FEATURES))


@query("order_strength", """SELECT feature, ROUND(strength, 9) + 0e0 AS strength,
CAST(ROW_NUMBER() OVER (ORDER BY ROUND(strength, 9) DESC, feature) AS INT) AS position FROM univariate""", "univariate")
def order_strength(spark, sf):
    """Position by distance from 0.5; one row per feature, so one small window."""
    from pyspark.sql import Window

    table = tidy(sensitivity.univariate_table(labelled(spark, sf, ALL_FEATURES), ALL_FEATURES))
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("strength"), "feature")
    return table.select("feature", "strength", F.row_number().over(place).alias("position")).orderBy("position")
