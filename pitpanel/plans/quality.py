"""Data-quality rules as issue rows, from one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.schemas import PLEDGE_STATUS
from pitpanel.settings import ALL_FEATURES

# What a feature can mean. (None: unbounded.)
FEATURE_BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "promoter_holding_pct": (0.0, 100.0),
    "pledge_pct_promoter": (0.0, 100.0),
    "pledge_pct_equity": (0.0, 100.0),
    "pledge_max_4q": (0.0, 100.0),
    "pledge_chg_1q": (-100.0, 100.0),
    "pledge_chg_2q": (-100.0, 100.0),
    "pledge_accel": (-200.0, 200.0),
    "consecutive_rising_q": (0.0, None),
    "volatility_90d": (0.0, None),
    "trailing_dd_60d": (-1.0, 0.0),
    "return_90d": (-1.0, None),
    "rel_return_90d": (-2.0, None),
    "log_turnover_90d": (None, None),
    "event_created_90d": (0.0, None),
    "event_released_90d": (0.0, None),
    "event_net_90d": (None, None),
    "event_count_90d": (0.0, None),
    "event_days_since": (0.0, None),
    "event_invocations_365d": (0.0, None),
}

# Range rules of the stored panel.
PANEL_RANGES: dict[str, tuple[float | None, float | None]] = {
    "promoter_holding_pct": (0.0, 100.0),
    "pledge_pct_promoter": (0.0, 100.0),
    "pledge_pct_equity": (0.0, 100.0),
    "pledge_max_4q": (0.0, 100.0),
    "volatility_90d": (0.0, None),
    "trailing_dd_60d": (-1.0, 0.0),
    "fwd_max_drawdown": (-1.0, None),
}
REQUIRED = ["symbol", "observation_date", "quarter_end", "label_is_valid"]


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """True for a known value beyond its bounds; NULL is never outside."""
    hit = F.lit(False)
    if low is not None:
        hit = hit | F.coalesce(value < low, F.lit(False))
    if high is not None:
        hit = hit | F.coalesce(value > high, F.lit(False))
    return hit


def validate_panel(panel: DataFrame, *, ranges=None, strict: bool = False) -> DataFrame:
    """(column, rule, n_violations, min, max) for every broken rule; none means the panel passed.

    Null and range rules share one aggregate; the key rule is a second one. Columns that are missing
    or not numeric are reported from the schema, without reading data.
    """
    ranges = PANEL_RANGES if ranges is None else ranges
    columns, rows, nothing = set(panel.columns), [], F.lit(None).cast("double")
    aggs: list[Column] = [F.count("*").alias("n_rows")]

    def row(column: str, rule: str, n: Column, low: Column = nothing, high: Column = nothing) -> None:
        rows.append(F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"),
                             n.cast("bigint").alias("n_violations"), low.alias("min"), high.alias("max")))

    for c in REQUIRED:
        if c in columns:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
            row(c, "not null", F.col(f"null_{c}"))
        else:
            row(c, "present", F.col("n_rows"))
    for c, (low, high) in ranges.items():
        if c not in columns:
            continue
        bad = F.when(outside(F.col(c), low, high), F.col(c))
        aggs += [F.count(bad).alias(f"n_{c}"), F.min(bad).alias(f"lo_{c}"), F.max(bad).alias(f"hi_{c}")]
        row(c, f"[{low}, {high}]", F.col(f"n_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    numeric = {f.name for f in panel.schema.fields if f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "decimal")}
    for c in ALL_FEATURES:
        if c not in columns:
            row(c, "feature present", F.lit(1))
        elif c not in numeric:
            row(c, "numeric type", F.lit(1))
    issues = panel.agg(*aggs).select(F.explode(F.array(*rows)).alias("__i")).select("__i.*")
    repeated = panel.groupBy("symbol", "observation_date").agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(
        F.lit("symbol,observation_date").alias("column"), F.lit("unique").alias("rule"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_violations"), nothing.alias("min"), nothing.alias("max"))
    out = issues.unionByName(repeated).where(F.col("n_violations") > 0)
    if strict:
        out = out.withColumn("rule", F.raise_error(F.concat_ws(" ", F.lit("panel validation failed:"), "column", "rule")))
    return out


def state_row_errors(state: DataFrame) -> DataFrame:
    """Filing rows with an ``errors`` array of broken row rules: keys, status words, shares, percentages."""
    def flag(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), text)

    checks = [flag(F.col(c).isNull() | (F.col(c).cast("string") == ""), f"{c} is missing")
              for c in ("symbol", "quarter_end", "submission_date", "pledge_status") if c in state.columns]
    checks += [flag(~F.col("pledge_status").isin(*PLEDGE_STATUS), "pledge_status is unknown")]
    checks += [flag(F.col(c) < 0, f"{c} is negative")
               for c in ("promoter_shares", "pledged_shares", "total_shares") if c in state.columns]
    checks += [flag(outside(F.col(c), 0.0, 100.0), f"{c} is outside 0..100")
               for c in ("promoter_holding_pct", "pledge_pct_promoter", "pledge_pct_equity") if c in state.columns]
    return state.withColumn("errors", F.array_compact(F.array(*checks)))
