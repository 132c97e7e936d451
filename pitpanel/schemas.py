"""The twelve tables: columns, types and business keys."""

from __future__ import annotations

from pyspark.sql import types as T

from pitpanel.settings import ALL_FEATURES

_S, _D, _I, _L, _F, _TS = (
    T.StringType(), T.DateType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(),
)


def _table(*columns: tuple[str, T.DataType], required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in columns])


_FEATURE_TYPES = [(n, _I if n == "consecutive_rising_q" else _F) for n in ALL_FEATURES]

# Column names and types of the data model.
TABLES: dict[str, T.StructType] = {
    "companies": _table(
        ("symbol", _S), ("company_name", _S), ("isin", _S), ("industry", _S),
        ("in_universe", _I), ("added_at", _TS)),
    "filings": _table(
        ("filing_id", _L), ("symbol", _S), ("quarter_end", _D), ("submission_date", _D),
        ("xbrl_url", _S), ("local_path", _S), ("sha256", _S), ("status", _S),
        ("error_message", _S), ("fetched_at", _TS)),
    "pledge_state": _table(
        ("symbol", _S), ("quarter_end", _D), ("submission_date", _D), ("promoter_shares", _F),
        ("pledged_shares", _F), ("total_shares", _F), ("promoter_holding_pct", _F),
        ("pledge_pct_promoter", _F), ("pledge_pct_equity", _F), ("pledge_status", _S), ("filing_id", _L)),
    "pledge_events": _table(
        ("event_id", _L), ("symbol", _S), ("event_date", _D), ("promoter_name", _S),
        ("event_type", _S), ("shares", _F), ("pct_equity", _F), ("lender", _S), ("reason", _S)),
    "prices": _table(("symbol", _S), ("trade_date", _D), ("adj_close", _F), ("volume", _F)),
    "benchmark": _table(("trade_date", _D), ("adj_close", _F)),
    "panel": _table(
        ("symbol", _S), ("observation_date", _D), ("quarter_end", _D), *_FEATURE_TYPES,
        ("is_stale", _I), ("fwd_max_drawdown", _F), ("label", _I), ("label_is_valid", _I)),
    "model_runs": _table(
        ("run_id", _S), ("created_at", _TS), ("model_name", _S), ("experiment", _S),
        ("feature_list", T.ArrayType(_S)), ("hyperparams", T.MapType(_S, _S)), ("random_seed", _I),
        ("n_train_rows", _L), ("n_folds", _I), ("artifact_path", _S), ("config_snapshot", _S),
        ("is_active", _I)),
    "model_metrics": _table(("run_id", _S), ("fold", _I), ("metric_name", _S), ("metric_value", _F)),
    "predictions": _table(
        ("prediction_id", _L), ("run_id", _S), ("symbol", _S), ("observation_date", _D),
        ("probability", _F), ("risk_decile", _I), ("source", _S), ("created_at", _TS)),
    "explanations": _table(
        ("prediction_id", _L), ("feature_name", _S), ("feature_value", _F), ("shap_value", _F)),
    "backtest_results": _table(
        ("run_id", _S), ("observation_date", _D), ("quintile", _I), ("n_companies", _L),
        ("n_events", _L), ("event_rate", _F)),
}

# Business keys. An empty key means append-only.
KEYS: dict[str, tuple[str, ...]] = {
    "companies": ("symbol",),
    "filings": ("symbol", "quarter_end", "xbrl_url"),
    "pledge_state": ("symbol", "quarter_end"),
    "pledge_events": ("symbol", "event_date", "promoter_name", "event_type", "shares"),
    "prices": ("symbol", "trade_date"),
    "benchmark": ("trade_date",),
    "panel": ("symbol", "observation_date"),
    "model_runs": ("run_id",),
    "model_metrics": ("run_id", "fold", "metric_name"),
    "predictions": (),
    "explanations": ("prediction_id", "feature_name"),
    "backtest_results": ("run_id", "observation_date", "quintile"),
}

# Allowed words.
FILING_STATUS = ("pending", "downloaded", "parsed", "failed", "quarantined")
PLEDGE_STATUS = ("PLEDGE_PRESENT", "NO_PLEDGE", "UNAVAILABLE")
PREDICTION_SOURCE = ("backtest", "api", "dashboard")
