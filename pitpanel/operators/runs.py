"""Runs, sessions and comparisons between them. Run tables hold one row per training run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.scalars import session_of
from pitpanel.operators import merge
from pitpanel.settings import Experiment

# Simplest model first.
SIMPLICITY = ["logreg", "random_forest", "xgboost"]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for every table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def sessions(runs: DataFrame) -> DataFrame:
    return runs.groupBy(session_of(F.col("run_id")).alias("session")).agg(
        F.count("*").alias("n_runs"), F.min("created_at").alias("started_at"), F.max("is_active").alias("has_active"))


def superseded_sessions(sessions: DataFrame, keep: int = 3) -> DataFrame:
    """(session) to delete: beyond the newest ``keep`` and not active. ``keep=0`` deletes nothing."""
    if keep <= 0:
        return sessions.where(F.lit(False)).select("session")
    newest = sessions.orderBy(F.desc("session")).limit(keep).select("session")
    return sessions.where(F.coalesce("has_active", F.lit(0)) == 0).join(newest, "session", "left_anti").select("session")


def prune_runs(tables: dict[str, DataFrame], keep: int = 3) -> tuple[dict[str, DataFrame], DataFrame]:
    """Keep the newest sessions and the active one; returns what remains and what went."""
    return merge.delete_sessions(tables, superseded_sessions(sessions(tables["model_runs"]), keep))


def require_active_run(runs: DataFrame) -> DataFrame:
    """The single active run; evaluating it fails when there is none or a second one."""
    picked = runs.agg(F.max_by(F.struct(*runs.columns), F.when(F.col("is_active") == 1, F.col("run_id"))).alias("__pick"),
                      F.count_if(F.col("is_active") == 1).alias("__n"))
    odd = F.when(F.col("__n") == 0, F.lit("no active run")).otherwise(F.concat(F.col("__n").cast("string"), F.lit(" active runs")))
    guard = F.when(F.col("__n") == 1, F.col("__pick.run_id")).otherwise(F.raise_error(odd).cast("string"))
    return picked.select(guard.alias("run_id"), *[F.col(f"__pick.{c}").alias(c) for c in runs.columns if c != "run_id"])


def flag_short_history(companies: DataFrame, prices: DataFrame, min_bars: int = 250) -> DataFrame:
    """Companies with ``n_bars``; too short a history clears in_universe and keeps the row."""
    counts = prices.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    joined = companies.join(counts, "symbol", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    return joined.withColumn("in_universe", F.when(F.col("n_bars") < min_bars, 0).otherwise(F.col("in_universe")))


def complete_universe(filings: DataFrame, min_quarters: int = 12, target: int = 300) -> DataFrame:
    """(symbol, n_quarters, median_kept): the most complete filers. The last step sees ``target`` rows."""
    counts = filings.groupBy("symbol").agg(F.countDistinct("quarter_end").alias("n_quarters"))
    kept = counts.where(F.col("n_quarters") >= min_quarters).orderBy(F.desc("n_quarters"), "symbol").limit(target)
    whole = Window.partitionBy(F.lit(0))
    return kept.withColumn("median_kept", F.percentile("n_quarters", F.lit(0.5)).over(whole))


def model_comparison(runs: DataFrame, metrics: DataFrame, metric: str, fold: int = -1) -> DataFrame:
    """Runs with one metric of one fold, best first."""
    wanted = metrics.where((F.col("metric_name") == metric) & (F.col("fold") == fold))
    return runs.join(wanted, "run_id").orderBy(F.desc("metric_value"), "run_id")


def metrics_wide(metrics: DataFrame, names: list[str], fold: int = -1) -> DataFrame:
    return metrics.where(F.col("fold") == fold).groupBy("run_id").pivot("metric_name", names).agg(F.max("metric_value"))


def comparison_table(runs: DataFrame, metrics: DataFrame, names: list[str]) -> DataFrame:
    wide = metrics_wide(metrics, names)
    return runs.select("run_id", "experiment", F.col("model_name").alias("model"), F.col("n_folds").alias("folds")).join(
        wide, "run_id", "left")


def median_delta(auc: DataFrame, pairs: DataFrame, by: list[str], tuned: str | None = None) -> DataFrame:
    """Treatment - baseline per model, then the median; the tuned model is left out of the clean median.

    Each median is over the models of one session.
    """
    own = [*by, "model_name"]
    ours = auc.join(F.broadcast(pairs), "experiment").select(*own, "experiment", "baseline", F.col("metric_value").alias("a"))
    base = auc.select(*own, F.col("experiment").alias("baseline"), F.col("metric_value").alias("b"))
    delta = ours.join(base, [*own, "baseline"]).withColumn("delta", F.col("a") - F.col("b")).where(F.col("delta").isNotNull())
    clean = F.when(F.col("model_name") != F.lit(tuned or ""), F.col("delta"))
    return delta.groupBy(*by, "experiment", "baseline").agg(
        F.percentile("delta", F.lit(0.5)).alias("median_delta"), F.percentile(clean, F.lit(0.5)).alias("clean_median_delta"),
        F.count("*").alias("n_models"), F.count_if(F.col("delta") > 0).alias("n_positive"),
        F.count_if(F.col("delta") <= 0).alias("n_negative"))


def select_best(auc: DataFrame, by: list[str], experiment: str, tolerance: float = 0.0) -> DataFrame:
    """Best run of the headline experiment; within the tolerance the simpler model wins."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in SIMPLICITY]), F.col("model_name")), F.lit(0))
    rank = F.when(place == 0, len(SIMPLICITY) + 1).otherwise(place)
    wanted = auc.where((F.col("experiment") == experiment) & F.col("metric_value").isNotNull())
    best = wanted.groupBy(*by).agg(F.max("metric_value").alias("__best"))
    tied = wanted.join(best, by).where(F.col("__best") - F.col("metric_value") <= tolerance).drop("__best")
    rest = [c for c in tied.columns if c not in by]
    order = F.struct(rank.alias("rank"), (-F.col("metric_value")).alias("m"), F.col("model_name"))
    return tied.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("__pick")).select(*by, "__pick.*")


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as an aggregate."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__pick")).select(*key, "__pick.*")


def extra_features(spark, experiments: list[Experiment]) -> DataFrame:
    """(experiment, baseline, extra, n_extra): what each experiment adds to its own baseline."""
    rows = spark.createDataFrame([(e.name, e.baseline, list(e.features)) for e in experiments],
                                 "experiment string, baseline string, features array<string>")
    base = rows.select(F.col("experiment").alias("baseline"), F.col("features").alias("base_features"))
    extra = F.array_except("features", "base_features")
    return rows.where(F.col("experiment") != F.col("baseline")).join(F.broadcast(base), "baseline").select(
        "experiment", "baseline", F.array_join(extra, ",").alias("extra"), F.size(extra).alias("n_extra"))
