"""Queries for scalar, array, map and text functions, and for attribution records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx, text, vectors
from pitpanel.operators import attribution
from pitpanel.plans import prep
from pitpanel.registered.base import piece, query, r
from pitpanel.registered.panels import panel, tidy
from pitpanel.session import materialise
from pitpanel.settings import ALL_FEATURES, MARKET_FEATURES, PLEDGE_FEATURES
from pitpanel.sources import adapters as src

_DAY = "CAST(o_orderdate AS DATE)"


@query("fn_parse_date_multi", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE {_DAY} END AS parsed FROM orders")
def fn_parse_date_multi(spark, sf):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = (F.when(k == 0, F.upper(F.date_format(day, "dd-MMM-yyyy"))).when(k == 1, F.date_format(day, "dd-MMMM-yyyy"))
           .when(k == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k == 3, F.date_format(day, "dd-MM-yyyy"))
           .when(k == 4, F.concat(F.lit("  "), F.date_format(day, "d-MMM-yyyy"))).otherwise("not a date"))
    return src.table(spark, sf, "orders").select("o_orderkey", fx.parse_date(raw).alias("parsed"))


@query("fn_clean_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice WHEN o_orderkey % 5 = 4 THEN -o_totalprice END AS cleaned FROM orders""")
def fn_clean_number(spark, sf):
    k, v = F.col("o_orderkey") % 5, F.col("o_totalprice")
    raw = (F.when(k == 0, F.concat(F.lit(" "), F.format_number(v, 2))).when(k == 1, "-").when(k == 2, "NULL")
           .when(k == 3, "12 abc").otherwise(F.format_number(-v, 2)))
    return src.table(spark, sf, "orders").select("o_orderkey", fx.clean_number(raw).alias("cleaned"))


@query("fn_clean_text", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS cleaned FROM customer""")
def fn_clean_text(spark, sf):
    k = F.col("c_custkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).when(k == 1, F.col("c_mktsegment"))
           .when(k == 2, "   ").otherwise("-"))
    return src.table(spark, sf, "customer").select("c_custkey", fx.clean_text(raw).alias("cleaned"))


@query("fn_normalise_event", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'creation'
WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'release' WHEN l_linestatus = 'F' THEN 'invocation'
WHEN l_returnflag = 'A' THEN 'release' WHEN l_returnflag = 'R' THEN 'something else' END AS event_type FROM lineitem""")
def fn_normalise_event(spark, sf):
    final, flag = F.col("l_linestatus") == "F", F.col("l_returnflag")
    raw = (F.when(final & (flag == "A"), " Creation of Pledge").when(final & (flag == "R"), "REVOKED")
           .when(final, "invoked ").when(flag == "A", "Partly Released").when(flag == "R", "Something Else").otherwise(" "))
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fx.normalise_event(raw).alias("event_type"))


@query("fn_quarter_ends", """SELECT symbol, CAST(LAST_DAY(CAST(q AS DATE)) AS DATE) AS quarter_end FROM
(SELECT l_suppkey AS symbol, CAST(MIN(l_shipdate) AS DATE) AS a, CAST(MAX(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY 1) s,
UNNEST(generate_series(DATE '1994-03-01', DATE '2003-12-01', INTERVAL 3 MONTH)) t(q)
WHERE LAST_DAY(CAST(q AS DATE)) BETWEEN a AND b""")
def fn_quarter_ends(spark, sf):
    spans = src.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    return spans.select("symbol", F.explode(fx.quarter_ends(F.col("a"), F.col("b"))).alias("quarter_end"))


@query("fn_date_shift", f"SELECT o_orderkey, {_DAY} - 14 AS window_end, {_DAY} + 30 AS due FROM orders")
def fn_date_shift(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return src.table(spark, sf, "orders").select(
        "o_orderkey", fx.shift_days(day, -14).alias("window_end"), fx.shift_days(day, 30).alias("due"))


@query("fn_log_guarded", "SELECT c_custkey, ROUND(CASE WHEN c_acctbal > 0 THEN LN(c_acctbal) END, 9) + 0e0 AS log_balance FROM customer")
def fn_log_guarded(spark, sf):
    return tidy(src.table(spark, sf, "customer").select("c_custkey", fx.log_or_null(F.col("c_acctbal")).alias("log_balance")))


# Preprocessing: fitted on labelled rows before 2000, applied to every row.
_FEATS = ["volatility_90d", "trailing_dd_60d", "log_turnover_90d", "pledge_accel"]
_CUT = "DATE '2000-01-01'"
piece("fit_rows", f"SELECT * FROM panel WHERE label_is_valid = 1 AND observation_date < {_CUT}", "panel")
piece("fit_bounds", "SELECT " + ", ".join(
    f"QUANTILE_CONT({f}, 0.01) AS lo_{f}, QUANTILE_CONT({f}, 0.99) AS hi_{f}" for f in _FEATS) + " FROM fit_rows", "fit_rows")
piece("fit_clip", "SELECT symbol, observation_date, " + ", ".join(
    f"CASE WHEN {f} IS NOT NULL THEN LEAST(GREATEST({f}, lo_{f}), hi_{f}) END AS {f}" for f in _FEATS) + " FROM fit_rows, fit_bounds", "fit_rows", "fit_bounds")
piece("fit_fill", "SELECT " + ", ".join(f"MEDIAN({f}) AS fill_{f}" for f in _FEATS) + " FROM fit_clip", "fit_clip")
piece("fit_mean", "SELECT " + ", ".join(
    f"AVG(COALESCE({f}, fill_{f})) AS mean_{f}, STDDEV_POP(COALESCE({f}, fill_{f})) AS std_{f}, "
    f"AVG(CAST({f} IS NULL AS DOUBLE)) AS gap_{f}, STDDEV_POP(CAST({f} IS NULL AS DOUBLE)) AS gapstd_{f}" for f in _FEATS) + " FROM fit_clip, fit_fill",
      "fit_clip", "fit_fill")


def _sql_clip(f: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN LEAST(GREATEST({f}, lo_{f}), hi_{f}) END"


def _fitted(spark, sf):
    frame = materialise(panel(spark, sf, ["symbol", "observation_date", "label_is_valid", *_FEATS]), "panel")
    train = frame.where((F.col("label_is_valid") == 1) & (F.col("observation_date") < F.lit(dt.date(2000, 1, 1))))
    return frame, prep.fit(train, _FEATS)


@query("fn_clip_quantiles", "SELECT symbol, observation_date, " + ", ".join(r(_sql_clip(f), 9, f) for f in _FEATS) + " FROM panel, fit_bounds", "panel", "fit_bounds")
def fn_clip_quantiles(spark, sf):
    frame, fitted = _fitted(spark, sf)
    return tidy(frame.select("symbol", "observation_date", *[
        prep.clipped(F.col(f), fitted.stats[f].low, fitted.stats[f].high).alias(f) for f in _FEATS]))


@query("fn_median_impute", "SELECT symbol, observation_date, " + ", ".join(
    r(f"COALESCE({_sql_clip(f)}, fill_{f})", 9, f"x_{f}") + f", CAST({f} IS NULL AS DOUBLE) AS x_{f}_missing" for f in _FEATS)
       + " FROM panel, fit_bounds, fit_fill", "panel", "fit_bounds", "fit_fill")
def fn_median_impute(spark, sf):
    """All four features have gaps in training, so each gets its indicator."""
    frame, fitted = _fitted(spark, sf)
    return tidy(fitted.transform(frame.select("symbol", "observation_date", *_FEATS), scale=False).drop(*_FEATS))


@query("fn_standardise", "SELECT symbol, observation_date, " + ", ".join(
    r(f"(COALESCE({_sql_clip(f)}, fill_{f}) - mean_{f}) / std_{f}", 7, f"x_{f}") + ", "
    + r(f"(CAST({f} IS NULL AS DOUBLE) - gap_{f}) / gapstd_{f}", 7, f"x_{f}_missing") for f in _FEATS)
       + " FROM panel, fit_bounds, fit_fill, fit_mean", "panel", "fit_bounds", "fit_fill", "fit_mean")
def fn_standardise(spark, sf):
    frame, fitted = _fitted(spark, sf)
    return tidy(fitted.transform(frame.select("symbol", "observation_date", *_FEATS)).drop(*_FEATS), places=7)


@query("fn_run_id", """SELECT run_id, SPLIT_PART(run_id, '_', 1) AS session FROM runs""", "runs")
def fn_run_id(spark, sf):
    built = src.runs(spark, sf).select(
        fx.run_id(fx.session_of(F.col("run_id")), F.col("model_name"), F.col("experiment")).alias("run_id"))
    return built.select("run_id", fx.session_of(F.col("run_id")).alias("session"))


@query("fn_url_basename", """SELECT page_id, CASE WHEN LOWER(b) LIKE '%.xml' THEN b ELSE b || '.xml' END AS basename FROM
(SELECT page_id, COALESCE(NULLIF(LIST_LAST(STRING_SPLIT(RTRIM(url, '/'), '/')), ''), 'unnamed') AS b FROM pages) p""")
def fn_url_basename(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", fx.url_basename(F.col("url")).alias("basename"))


@query("fn_verdict", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'UNKNOWN' WHEN l_discount - 0.05e0 > 0 THEN 'POSITIVE'
WHEN l_tax - 0.05e0 + l_discount - 0.05e0 < 0 THEN 'NEGATIVE' ELSE 'ZERO' END AS verdict FROM lineitem""")
def fn_verdict(spark, sf):
    low = F.when(F.col("l_returnflag") != "N", F.col("l_discount") - 0.05)
    high = F.col("l_tax") - 0.05 + F.col("l_discount") - 0.05
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fx.verdict(low, high).alias("verdict"))


@query("fn_phrase")
def fn_phrase(spark, sf):
    long = prep.long_features(panel(spark, sf), ALL_FEATURES, ("symbol", "observation_date"))
    return long.select("symbol", "observation_date", "feature", text.phrase(F.col("feature"), F.col("value")).alias("phrase"))


# Filing rules over facts already shredded ----------------------------------------------------

@query("case_pledge_status", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'NO_PLEDGE' WHEN l_tax > 0.075e0 AND l_returnflag = 'N' THEN 'UNAVAILABLE'
WHEN l_tax <= 0.075e0 AND l_discount > 0 THEN 'PLEDGE_PRESENT' WHEN l_returnflag = 'A' THEN 'PLEDGE_PRESENT' ELSE 'NO_PLEDGE' END AS status FROM lineitem""")
def case_pledge_status(spark, sf):
    pledged = F.when(F.col("l_tax") <= 0.075, F.col("l_discount"))
    flag = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fx.pledge_status(pledged, flag, F.col("l_linenumber") == 7).alias("status"))


@query("reported_or_ratio", """SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN l_tax > 0 THEN l_tax * 1e2 WHEN l_discount <> 0 THEN 1e2 * l_quantity / l_discount END, 6) + 0e0 AS pct FROM lineitem""")
def reported_or_ratio(spark, sf):
    reported = F.when(F.col("l_tax") > 0, F.col("l_tax") * 100)
    out = fx.reported_or_ratio(reported, F.col("l_quantity"), F.col("l_discount"))
    return tidy(src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", out.alias("pct")), places=6)


# Arrays and maps -----------------------------------------------------------------------------

_STALE = "'the filing is carried over; at most 1 quarter(s) back are used'"
_BLANK = "CONCAT_WS(', ', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in MARKET_FEATURES) + ")"
_N_BLANK = " + ".join(f"CAST({f} IS NULL AS INT)" for f in MARKET_FEATURES)
_IMPUTED = f"""CAST({_N_BLANK} AS VARCHAR) || ' input(s) had no value and took the training median: ' || {_BLANK} || '. Part of the score therefore reflects what is not known.'"""
_OPEN = "'the outcome window is still open, so there is nothing to compare the score with'"
_DATA = f"CASE WHEN is_stale = 1 THEN {_STALE} END, CASE WHEN {_N_BLANK} > 0 THEN {_IMPUTED} END"


@query("arr_warnings", f"""SELECT symbol, observation_date, CONCAT_WS(' | ', {_DATA}, CASE WHEN label_is_valid = 0 THEN {_OPEN} END) AS warnings,
CONCAT_WS(' | ', {_DATA}) AS data_warnings FROM panel""", "panel")
def arr_warnings(spark, sf):
    items = text.warning_items(MARKET_FEATURES)
    return panel(spark, sf).select(
        "symbol", "observation_date", F.array_join(text.warning_messages(items), " | ").alias("warnings"),
        F.array_join(text.warning_messages(items, text.DATA_CODES), " | ").alias("data_warnings"))


_VECTOR = """SELECT l_orderkey, l_linenumber, l_quantity * 3 AS hold, l_discount - 0.03e0 AS vol, CASE WHEN l_tax > 0.02e0 THEN l_tax - 0.05e0 END AS dd FROM lineitem"""


def _vectors(spark, sf):
    hold, vol = F.col("l_quantity") * 3, F.col("l_discount") - 0.03
    dd = F.when(F.col("l_tax") > 0.02, F.col("l_tax") - 0.05)
    entries = F.create_map(F.lit("promoter_holding_pct"), hold, F.lit("volatility_90d"), vol, F.lit("trailing_dd_60d"), dd,
                           F.lit("not_a_feature"), F.lit(-1e9))
    kept = F.map_filter(entries, lambda k, v: (k != "volatility_90d") | (F.col("l_linenumber") != 3))
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kept.alias("vector"))


@query("arr_feature_violations", f"""SELECT l_orderkey, l_linenumber, CAST(hold > 100 AS INT) + CAST(vol < 0 AND l_linenumber <> 3 AS INT) + CAST(COALESCE(dd > 0, FALSE) AS INT) AS n_problems,
CASE WHEN hold > 100 THEN 'promoter_holding_pct=' || CAST(CAST(hold AS BIGINT) AS VARCHAR) || ' is above the maximum 100' END AS first_problem FROM ({_VECTOR}) v""")
def arr_feature_violations(spark, sf):
    problems = vectors.domain_violations(F.col("vector"))
    first = F.get(F.filter(problems, lambda x: x.startswith("promoter_holding_pct")), 0)
    return _vectors(spark, sf).select("l_orderkey", "l_linenumber", F.size(problems).alias("n_problems"), first.alias("first_problem"))


@query("arr_required_keys", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'volatility_90d,return_90d' ELSE 'return_90d' END AS missing FROM lineitem""")
def arr_required_keys(spark, sf):
    gone = vectors.missing_keys(F.col("vector"), ["promoter_holding_pct", "volatility_90d", "return_90d"])
    return _vectors(spark, sf).select("l_orderkey", "l_linenumber", F.array_join(gone, ",").alias("missing"))


def _run_rows(spark, sf):
    runs = src.runs(spark, sf)
    return runs.withColumn("feature_list", F.array(F.lit("volatility_90d"), F.col("experiment"))).withColumn(
        "hyperparams", F.create_map(F.lit("model"), F.col("model_name"), F.lit("rows"), F.col("n_train_rows").cast("string")))


@query("json_run_columns", """SELECT run_id, 'volatility_90d,' || experiment AS features, CAST(n_train_rows AS VARCHAR) AS n_rows, 2 AS n_params FROM runs""", "runs")
def json_run_columns(spark, sf):
    back = vectors.run_columns_from_json(vectors.run_columns_to_json(_run_rows(spark, sf)))
    return back.select("run_id", F.array_join("feature_list", ",").alias("features"),
                       F.col("hyperparams")["rows"].alias("n_rows"), F.size("hyperparams").alias("n_params"))


@query("json_config_snapshot", f"SELECT run_id, '{src.STUDY.snapshot()}' AS config_snapshot FROM runs", "runs")
def json_config_snapshot(spark, sf):
    return src.runs(spark, sf).select("run_id", F.lit(src.STUDY.snapshot()).alias("config_snapshot"))


@query("map_model_info", f"""SELECT run_id, CAST(COUNT(*) AS INT) AS n_metrics, {r("MAX(metric_value) FILTER (metric_name = 'pr_auc')", 9, 'pr_auc')} FROM run_metrics WHERE fold = -1 GROUP BY 1""", "run_metrics")
def map_model_info(spark, sf):
    info = vectors.model_info(_run_rows(spark, sf), src.run_metrics(spark, sf))
    return tidy(info.select("run_id", F.size("metrics").alias("n_metrics"), F.col("metrics")["pr_auc"].alias("pr_auc")))


@query("vec_assemble")
def vec_assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array

    frame, fitted = _fitted(spark, sf)
    names = [f"x_{n}" for n in fitted.names]
    rows = vectors.assemble(fitted.transform(frame), names)
    return rows.select("symbol", "observation_date", F.size(vector_to_array("features")).alias("width"),
                       F.get(vector_to_array("features"), 0).alias("first"))


# Attribution records -------------------------------------------------------------------------

piece("records", "SELECT * FROM explanations", "explanations")
piece("importance", """SELECT feature, mean_abs_shap, mean_shap, mean_abs_shap / SUM(mean_abs_shap) OVER () AS share FROM
(SELECT feature_name AS feature, AVG(ABS(shap_value)) AS mean_abs_shap, AVG(shap_value) AS mean_shap FROM explanations GROUP BY 1) x""", "explanations")


@query("agg_importance", f"SELECT feature, {r('mean_abs_shap')}, {r('mean_shap')}, {r('share')} FROM importance", "importance")
def agg_importance(spark, sf):
    return tidy(attribution.importance(src.explanations(spark, sf)))


@query("agg_confound_audit", f"""SELECT {r("SUM(share) FILTER (feature IN ('pledge_pct_promoter', 'pledge_chg_1q'))", 9, 'block_share')},
{r("1 - SUM(share) FILTER (feature IN ('pledge_pct_promoter', 'pledge_chg_1q'))", 9, 'other_share')}, ARG_MIN(feature, rk) AS top_feature,
STRING_AGG(CASE WHEN rk <= 3 THEN feature END, ',' ORDER BY rk) AS top_3, CAST(MIN(rk) FILTER (feature IN ('pledge_pct_promoter', 'pledge_chg_1q')) AS INT) AS best_block_rank
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY mean_abs_shap DESC, feature) AS rk FROM importance) i""", "importance")
def agg_confound_audit(spark, sf):
    return tidy(attribution.confound_audit(attribution.importance(src.explanations(spark, sf)), PLEDGE_FEATURES))


# Sizes are rounded before they are ranked: equal sizes must tie the same way in both engines.
def _records(spark, sf):
    return src.explanations(spark, sf).withColumn("shap_value", fx.rounded(F.col("shap_value"), 9))


piece("steady", "SELECT prediction_id, feature_name, feature_value, ROUND(shap_value, 9) + 0e0 AS shap_value FROM explanations", "explanations")
piece("merged", """SELECT prediction_id, feature_name, feature_value, ROUND(shap_value, 9) + 0e0 AS shap_value FROM
(SELECT prediction_id, REGEXP_REPLACE(feature_name, '_missing$', '') AS feature_name, MAX(feature_value) FILTER (feature_name NOT LIKE '%_missing') AS feature_value,
SUM(shap_value) AS shap_value FROM steady GROUP BY 1, 2) m""", "steady")


@query("topk_contributions", """SELECT prediction_id, feature_name, feature_value, shap_value, CAST(rn AS INT) AS position FROM (SELECT *,
ROW_NUMBER() OVER (PARTITION BY prediction_id ORDER BY ABS(shap_value) DESC, feature_name) AS rn FROM steady) x WHERE rn <= 2""", "steady")
def topk_contributions(spark, sf):
    return attribution.ranked_records(_records(spark, sf), ["prediction_id"], 2)


@query("arr_merge_indicators", """SELECT prediction_id, feature_name, feature_value, shap_value, CAST(ROW_NUMBER() OVER (PARTITION BY prediction_id
ORDER BY ABS(shap_value) DESC, feature_name) AS INT) AS position FROM merged""", "merged")
def arr_merge_indicators(spark, sf):
    folded = attribution.merge_indicators(_records(spark, sf), ["prediction_id"])
    return attribution.ranked_records(folded.withColumn("shap_value", fx.rounded(F.col("shap_value"))), ["prediction_id"])


@query("arr_explanation_sentence")
def arr_explanation_sentence(spark, sf):
    scored = src.predictions(spark, sf).select(
        "prediction_id", "probability", fx.risk_band(F.col("probability"), src.STUDY.evaluation.risk_bands).alias("risk_band"))
    return attribution.sentences(src.explanations(spark, sf), scored, ["prediction_id"])


_COEF = {"volatility_90d": 0.8, "trailing_dd_60d": -0.5, "log_turnover_90d": -0.3}


piece("full_rows", "SELECT * FROM panel WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in _COEF), "panel")


@query("attrib_linear", " UNION ALL ".join(
    f"""SELECT symbol, observation_date, '{f}' AS feature_name, ROUND({c}e0 * ({f} - m), 8) + 0e0 AS shap_value FROM full_rows,
(SELECT AVG({f}) AS m FROM full_rows WHERE label_is_valid = 1) b""" for f, c in _COEF.items()), "full_rows")
def attrib_linear(spark, sf):
    # Dropped from the stored rows: above the panel's own plan the test would be pushed below its windows, which are then worked out again for it.
    rows = materialise(panel(spark, sf, ["symbol", "observation_date", "label_is_valid", *_COEF]), "panel").dropna(subset=list(_COEF))
    background = rows.where(F.col("label_is_valid") == 1)
    return tidy(attribution.linear_contributions(rows, background, _COEF, ["symbol", "observation_date"]), places=8)


piece("attrib_raw", """SELECT prediction_id, 'volatility_90d' AS feature_name, l_quantity / 1e2 AS raw FROM
(SELECT l_orderkey * 10 + l_linenumber AS prediction_id, MIN(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) l""")


@query("attrib_rows", """SELECT s.prediction_id, s.feature_name, raw AS feature_value, shap_value, CAST(ROW_NUMBER() OVER (PARTITION BY s.prediction_id
ORDER BY ABS(shap_value) DESC, s.feature_name) AS INT) AS position FROM steady s
LEFT JOIN attrib_raw a ON a.prediction_id = s.prediction_id AND a.feature_name = s.feature_name""", "steady", "attrib_raw")
def attrib_rows(spark, sf):
    """Records carry raw values, not the model's inputs, and are stored by key."""
    from pitpanel.operators.merge import merge_update

    raw = src.lines(spark, sf).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("prediction_id"), (F.col("l_quantity") / 100).alias("volatility_90d"))
    named = attribution.with_raw_values(_records(spark, sf).drop("feature_value"), raw, ["volatility_90d"], ["prediction_id"])
    older = named.where("feature_name <> 'pledge_chg_1q'").withColumn("shap_value", F.lit(0.0))  # an earlier run's rows
    stored = merge_update(older, named, ["prediction_id", "feature_name"])
    return attribution.ranked_records(stored, ["prediction_id"])
