"""Quantile backtest: realised event rate per risk band."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.metrics import median, rank_groups
from pitpanel.operators.ordering import join_groups

# The measures of the side-by-side table, in order.
COMPARED = [
    ("base_rate", "base event rate"),
    ("q1_event_rate", "Q1 (safest) event rate"),
    ("q5_event_rate", "Q5 (riskiest) event rate"),
    ("separation_diff", "Q5 - Q1"),
    ("separation_ratio", "Q5 / Q1"),
    ("lift_q5", "Q5 / base (lift)"),
    ("ratio_median", "median per-date Q5/Q1"),
    ("n_dates_monotonic", "dates monotonic across quintiles"),
    ("n_dates_q5_beats_q1", "dates where Q5 > Q1"),
]


def join_labels(predictions: DataFrame, labels: DataFrame, key: list[str], label: str = "label",
                probability: str = "probability") -> DataFrame:
    """Predictions with a realised outcome; the unlabelled ones drop out."""
    return predictions.join(labels.select(*key, label), key).where(
        F.col(probability).isNotNull() & F.col(label).isNotNull())


def quintile_table(scored: DataFrame, group: list[str], n: int = 5, date: str = "observation_date") -> DataFrame:
    """(group, date, quintile, n_companies, n_events, event_rate) of labelled predictions."""
    banded = rank_groups(scored.select(*group, date, "symbol", "probability", "label"), [*group, date],
                         "probability", n, out="quintile")
    return banded.groupBy(*group, date, "quintile").agg(
        F.count("*").alias("n_companies"), F.sum("label").cast("bigint").alias("n_events"),
        F.avg("label").alias("event_rate"))


def pool_quintiles(table: DataFrame, group: list[str]) -> DataFrame:
    """Counts pooled over dates inside each quintile."""
    pooled = table.groupBy(*group, "quintile").agg(
        F.sum("n_companies").alias("n_companies"), F.sum("n_events").alias("n_events"))
    return pooled.withColumn("event_rate", F.col("n_events") / F.col("n_companies"))


def separation(table: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Top against bottom band per key. A missing band is not monotonic; a zero bottom has no ratio."""
    rates = [F.max(F.when(F.col("quintile") == q, F.col("event_rate"))).alias(f"r{q}") for q in range(1, n + 1)]
    wide = table.groupBy(*keys).agg(
        (F.sum("n_events") / F.sum("n_companies")).alias("base_rate"), *rates)
    low, top, base = F.col("r1"), F.col(f"r{n}"), F.col("base_rate")
    rising = reduce(lambda a, b: a & b, [F.col(f"r{q + 1}") >= F.col(f"r{q}") for q in range(1, n)])
    return wide.select(
        *keys, "base_rate", low.alias("q1_event_rate"), top.alias("q5_event_rate"),
        F.when(low > 0, top / low).alias("separation_ratio"), (top - low).alias("separation_diff"),
        F.when(base > 0, top / base).alias("lift_q5"), F.coalesce(rising, F.lit(False)).alias("monotonic"))


def summary(table: DataFrame, group: list[str], n: int = 5, date: str = "observation_date") -> DataFrame:
    """Pooled figures beside the per-date spread. The last aggregate runs over dates only."""
    per_date = separation(table, [*group, date], n)
    spread = per_date.groupBy(*group).agg(
        F.count("*").alias("n_dates"), F.count_if("monotonic").alias("n_dates_monotonic"),
        F.count_if(F.col("separation_diff") > 0).alias("n_dates_q5_beats_q1"),
        median(F.col("separation_ratio")).alias("ratio_median"), F.min("separation_ratio").alias("ratio_min"),
        F.max("separation_ratio").alias("ratio_max"),
        F.count_if(F.col("separation_ratio").isNull()).alias("n_dates_ratio_undefined"))
    return join_groups(separation(pool_quintiles(table, group), group, n), spread, group)


def compare(summaries: DataFrame, key: str, headline: str, null: str) -> DataFrame:
    """(position, measure, headline, null): two summaries side by side."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(text).alias("measure"), F.col(c).cast("double").alias("value"))
        for i, (c, text) in enumerate(COMPARED)]))
    long = summaries.where(F.col(key).isin(headline, null)).select(key, rows.alias("__m")).select(key, "__m.*")
    return long.groupBy("position", "measure").agg(
        F.max(F.when(F.col(key) == headline, F.col("value"))).alias("headline"),
        F.max(F.when(F.col(key) == null, F.col("value"))).alias("null_model"))
