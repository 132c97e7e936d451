"""Sweeps over window lengths and materiality cuts, and single-feature AUCs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.events import filter_material, is_material, threshold_features, window_features
from pitpanel.operators.metrics import within_date_auc
from pitpanel.session import materialise

# The default sweep points.
WINDOWS = (30, 90, 180, 365, 730)
THRESHOLDS = (0.0, 0.01, 0.10, 0.50)


def feature_auc(long: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Mean within-date AUC per key of a long table (keys, observation_date, label, value); NULL counts as 0."""
    filled = long.withColumn("value", F.coalesce("value", F.lit(0.0)))
    detail = within_date_auc(filled, keys, score="value", min_rows=min_rows)
    return detail.groupBy(*keys).agg(F.avg("auc").alias("auc"))


def _sweep(built: DataFrame, labelled: DataFrame, key: str, measures: list[str], min_rows: int) -> DataFrame:
    """Coverage and one AUC column per measure for each sweep point."""
    built = materialise(built, "sweep")
    cover = built.groupBy(key).agg(F.avg((F.col("count") > 0).cast("double")).alias("coverage"))
    joined = built.join(labelled.select("symbol", "observation_date", "label"), ["symbol", "observation_date"])
    long = joined.unpivot([key, "observation_date", "label"], measures, "measure", "value")
    wide = feature_auc(long, [key, "measure"], min_rows).groupBy(key).pivot("measure", measures).agg(F.max("auc"))
    return cover.join(wide, key, "left")


def window_sweep(events: DataFrame, labelled: DataFrame, *, windows=WINDOWS, lag_days: int = 14,
                 min_pct_equity: float = 0.01, configured: int = 90, min_rows: int = 10) -> DataFrame:
    """The event block rebuilt at each window length: coverage and AUC of count, net and created."""
    built = window_features(labelled, filter_material(events, min_pct_equity), tuple(windows), lag_days)
    out = _sweep(built, labelled, "window_days", ["count", "net", "created"], min_rows)
    return out.withColumn("configured", F.col("window_days") == configured)


def materiality_sweep(events: DataFrame, labelled: DataFrame, *, thresholds=THRESHOLDS, window_days: int = 90,
                      lag_days: int = 14, configured: float = 0.01, min_rows: int = 10) -> DataFrame:
    """What each cut keeps, drops and is worth."""
    built = threshold_features(labelled, events, tuple(thresholds), window_days=window_days, lag_days=lag_days)
    out = _sweep(built, labelled, "min_pct_equity", ["count", "net"], min_rows).withColumnsRenamed(
        {"count": "count_auc", "net": "net_auc"})
    one = events.agg(F.count("*").alias("total"), *[
        c for i, t in enumerate(thresholds) for c in (
            F.count_if(is_material(t)).alias(f"k{i}"),
            F.countDistinct(F.when(is_material(t), F.col("symbol"))).alias(f"s{i}"))])
    kept = one.select(F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("min_pct_equity"), F.col(f"k{i}").alias("events_kept"),
                 (F.col("total") - F.col(f"k{i}")).alias("events_dropped"), F.col(f"s{i}").alias("companies"))
        for i, t in enumerate(thresholds)])).alias("__k")).select("__k.*")
    return out.join(F.broadcast(kept), "min_pct_equity").withColumn(
        "configured", F.col("min_pct_equity") == float(configured))


def univariate_table(labelled: DataFrame, features: list[str], *, min_rows: int = 10) -> DataFrame:
    """Every feature's own AUC, its mirror, strength, coverage and share of nonzero values.

    ``labelled`` is read twice; pass a stored panel.
    """
    present = [f for f in features if f in labelled.columns]
    long = labelled.select("observation_date", "label", *[F.col(f).cast("double").alias(f) for f in present]).unpivot(
        ["observation_date", "label"], present, "feature", "value")
    shares = long.groupBy("feature").agg(
        F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"),
        F.avg((F.coalesce("value", F.lit(0.0)) != 0).cast("double")).alias("nonzero"))
    auc = feature_auc(long, ["feature"], min_rows).where(F.col("auc").isNotNull())
    return auc.join(shares, "feature").select(
        "feature", "auc", (1 - F.col("auc")).alias("auc_if_inverted"),
        F.abs(F.col("auc") - 0.5).alias("strength"), "coverage", "nonzero")
