"""Scoring of one date's cohort and of ad-hoc feature vectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx, text, vectors
from pitpanel.operators.merge import delete_where
from pitpanel.operators.metrics import rank_groups
from pitpanel.operators.ordering import quantiles
from pitpanel.plans.training import load_active, score
from pitpanel.session import materialise
from pitpanel.settings import Evaluation


def newest_date(panel: DataFrame):
    return panel.agg(F.max("observation_date")).first()[0]


def score_date(pipeline: PipelineModel, panel: DataFrame, features: list[str], run_id: str, date=None,
               e: Evaluation | None = None) -> DataFrame:
    """Everyone on one date: probability, decile inside the date, band and warnings. Default: the newest date."""
    e = e or Evaluation()
    date = newest_date(panel) if date is None else date
    cohort = panel.where(F.col("observation_date") == F.lit(date))
    scored = rank_groups(score(pipeline, cohort), ["observation_date"], "probability", e.n_deciles, out="risk_decile")
    items = text.warning_items(features)
    return scored.select(
        "*", F.lit(run_id).alias("run_id"), fx.risk_band(F.col("probability"), e.risk_bands).alias("risk_band"),
        text.warning_messages(items).alias("warnings"), text.warning_messages(items, text.DATA_CODES).alias("data_warnings"))


def score_active(runs: DataFrame, panel: DataFrame, date=None, e: Evaluation | None = None) -> DataFrame:
    """``score_date`` by the stored pipeline of the active run, under that run's id."""
    run, pipeline = load_active(runs)
    return score_date(pipeline, panel, list(run["feature_list"]), run["run_id"], date, e)


def replace_slice(predictions: DataFrame, scored: DataFrame, run_id: str, date, source: str = "backtest") -> DataFrame:
    """Stored predictions with one (run, date, source) slice replaced, so scoring again changes nothing."""
    scope = (F.col("run_id") == run_id) & (F.col("observation_date") == F.lit(date)) & (F.col("source") == source)
    fresh = scored.withColumn("source", F.lit(source))
    return delete_where(predictions, scope).unionByName(
        fresh.select(*[c for c in predictions.columns if c in fresh.columns]), allowMissingColumns=True)


def score_vectors(pipeline: PipelineModel, rows: DataFrame, features: list[str], vector: str = "vector",
                  e: Evaluation | None = None) -> DataFrame:
    """Probability and band of feature maps. No cohort, so no decile.

    A vector that lacks a feature or holds an impossible value fails the job that reads it.
    """
    e = e or Evaluation()
    gone, odd = vectors.missing_keys(F.col(vector), features), vectors.domain_violations(F.col(vector))
    guard = F.when(F.size(gone) > 0, F.raise_error(F.concat(F.lit("missing required features: "), F.array_join(gone, ", "))).cast("map<string,double>")).when(
        F.size(odd) > 0, F.raise_error(F.array_join(odd, "; ")).cast("map<string,double>")).otherwise(F.col(vector))
    wide = rows.withColumn("__v", guard).select("*", *[F.try_element_at("__v", F.lit(f)).alias(f) for f in features])
    out = score(pipeline, wide.drop("__v"))
    return out.select(
        *rows.columns, "probability", F.lit(None).cast("int").alias("risk_decile"),
        fx.risk_band(F.col("probability"), e.risk_bands).alias("risk_band"),
        F.array(F.lit("scored from supplied features - no cohort, so no decile")).alias("warnings"))


def watchlist(scored: DataFrame, n: int = 20, bands: list[str] | None = None, pledged_only: bool = False) -> DataFrame:
    """Highest probabilities first; Spark keeps n rows per task before the final merge."""
    if bands is not None:
        scored = scored.where(F.col("risk_band").isin(*bands))
    if pledged_only:
        scored = scored.where(F.col("pledge_pct_promoter") > 0)
    return scored.orderBy(F.desc("probability"), "symbol").limit(n)


def cohort_summary(scored: DataFrame, e: Evaluation | None = None) -> DataFrame:
    """One row per date: median probability, elevated, pledged and unknown counts."""
    e = e or Evaluation()
    rows = materialise(scored.select("observation_date", "probability", "risk_band", "pledge_pct_promoter"), "cohort")
    middle = quantiles(rows, ["observation_date"], "probability", {"median_probability": 0.5})
    counts = rows.groupBy("observation_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_band").isin(*fx.elevated_bands(e.risk_bands))).alias("n_elevated"),
        F.count_if(F.col("pledge_pct_promoter") > 0).alias("n_pledged"),
        F.count_if(F.col("pledge_pct_promoter").isNull()).alias("n_unknown"))
    return counts.join(middle, "observation_date")
