"""The machine-readable snapshot of headline numbers: one JSON line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions.scalars import session_of
from pitpanel.operators.stored import VersionedTable
from pitpanel.settings import EXPERIMENTS, Settings


def key_numbers(panel: DataFrame, runs: DataFrame, metrics: DataFrame, settings: Settings) -> DataFrame:
    """One row of nested numbers. The metric list covers the newest session only: models x experiments."""
    ok = F.col("label_is_valid") == 1
    size = panel.agg(
        F.count_if(ok).alias("n_labelled_rows"), F.countDistinct(F.when(ok, F.col("observation_date"))).alias("n_observation_dates"),
        F.round(F.avg(F.when(ok, F.col("label"))), 6).alias("base_rate"))
    named = runs.withColumn("session", session_of(F.col("run_id")))
    head = named.agg(F.max("session").alias("training_session"),
                     F.max(F.when(F.col("is_active") == 1, F.col("run_id"))).alias("active_run_id"))
    newest = named.join(F.broadcast(head.select(F.col("training_session").alias("session"))), "session")
    wanted = metrics.where((F.col("fold") == -1) & (F.col("metric_name") == settings.metric))
    primary = newest.join(wanted, "run_id").agg(F.sort_array(F.collect_list(F.struct(
        F.concat_ws("|", "experiment", "model_name").alias("run"), F.round("metric_value", 6).alias("value")))).alias("primary_metric"))
    w, e = settings.windows, settings.evaluation
    config = F.struct(
        F.lit(w.horizon_bars).alias("horizon_bars"), F.lit(w.threshold).alias("threshold"),
        F.lit(w.disclosure_lag_days).alias("disclosure_lag_days"), F.lit(w.min_pct_equity).alias("min_pct_equity"),
        F.lit(e.n_bootstrap).alias("n_bootstrap"), F.lit(e.confidence).alias("confidence"), F.lit(e.seed).alias("seed"))
    features = F.struct(*[F.array(*[F.lit(f) for f in sorted(x.features)]).alias(x.name) for x in EXPERIMENTS])
    out = size.withColumn("__one", F.lit(1))
    for part in (head, primary):
        out = out.join(F.broadcast(part.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one").select("*", config.alias("config"), features.alias("experiments"))


def write_snapshot(panel: DataFrame, runs: DataFrame, metrics: DataFrame, settings: Settings, path: str) -> None:
    """A new version of the snapshot. Readers see the one before until the new one is complete."""
    numbers = key_numbers(panel, runs, metrics, settings)
    VersionedTable(path, "text").write(numbers.select(F.to_json(F.struct(*numbers.columns)).alias("value")).coalesce(1))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTable(path, "text").read(spark).withColumnRenamed("value", "snapshot")
