"""Ranking and calibration metrics, pooled or inside any grouping.

All rank metrics start from counts per distinct score, so equal scores shrink before they are
ordered, and use ``ordering.running`` so that one huge date is never sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.ordering import join_groups, positions, quantiles, running, top_k


def score_counts(df: DataFrame, group: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    """(group, score, pos, n) over rows where both score and label are known."""
    clean = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return clean.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n"))


def auc_from_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, n_positive, auc): Mann-Whitney with ties counted half; NULL for a single class."""
    ranked = running(counts, group, ["score"], {"neg_run": F.col("n") - F.col("pos")})
    neg = F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos") * (F.col("neg_run") - neg / 2))
    out = ranked.groupBy(*group).agg(wins.alias("wins"), F.sum("n").alias("n"), F.sum("pos").alias("n_positive"))
    pairs = F.col("n_positive") * (F.col("n") - F.col("n_positive"))
    return out.select(*group, "n", "n_positive", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


def pooled_auc(df: DataFrame, group: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    return auc_from_counts(score_counts(df, group, score, label), group).select(
        *group, F.col("auc").alias("pooled_auc"))


def with_skip_reason(auc: DataFrame, min_rows: int = 10) -> DataFrame:
    """A thin or single-class date has no AUC; it is reported, not scored."""
    thin = F.col("n") < min_rows
    single = (F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n"))
    return auc.select(
        *[c for c in auc.columns if c != "auc"],
        F.when(~(thin | single), F.col("auc")).alias("auc"), (thin | single).alias("skipped"),
        F.when(thin, "too few rows").when(single, "single class").otherwise("").alias("reason"))


def within_date_auc(df: DataFrame, group: list[str], date: str = "observation_date", *,
                    score: str = "probability", label: str = "label", min_rows: int = 10) -> DataFrame:
    """One row per (group, date) with its AUC or the reason for skipping it."""
    keys = [*group, date]
    return with_skip_reason(auc_from_counts(score_counts(df, keys, score, label), keys), min_rows)


def auc_spread(detail: DataFrame, group: list[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest of the scored dates."""
    return detail.groupBy(*group).agg(
        F.avg("auc").alias("within_quarter_auc"), F.stddev_samp("auc").alias("within_quarter_auc_std"),
        F.min("auc").alias("within_quarter_auc_min"), F.max("auc").alias("within_quarter_auc_max"),
        F.count_if(~F.col("skipped")).alias("n_dates_scored"), F.count_if("skipped").alias("n_dates_skipped"))


def _falling(counts: DataFrame, group: list[str]) -> DataFrame:
    return running(counts.withColumn("__desc", -F.col("score")), group, ["__desc"],
                   {"tp": F.col("pos"), "seen": F.col("n")})


def average_precision(df: DataFrame, group: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds; NULL for a single class."""
    run = _falling(score_counts(df, group, score, label), group)
    step = F.col("pos") / F.nullif(F.col("tp_total"), F.lit(0)) * (F.col("tp") / F.col("seen"))
    single = F.max(F.col("tp_total") == F.col("seen_total"))
    return run.groupBy(*group).agg(F.when(~single, F.sum(step)).alias("pr_auc"))


def roc_points(df: DataFrame, group: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    """Curve points at every distinct score, and the origin with a NULL threshold."""
    run = _falling(score_counts(df, group, score, label), group)
    neg_total = F.col("seen_total") - F.col("tp_total")
    points = run.select(
        *group, F.col("score").alias("threshold"),
        ((F.col("seen") - F.col("tp")) / F.nullif(neg_total, F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("tp_total"), F.lit(0))).alias("tpr"))
    origin = df.select(*group).distinct().select(
        *group, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_points(df: DataFrame, group: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0) with a NULL threshold."""
    run = _falling(score_counts(df, group, score, label), group)
    points = run.select(
        *group, F.col("score").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"),
        (F.col("tp") / F.nullif(F.col("tp_total"), F.lit(0))).alias("recall"))
    end = df.select(*group).distinct().select(
        *group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def brier(df: DataFrame, group: list[str], score: str = "probability", label: str = "label") -> DataFrame:
    """Brier score and its skill against always predicting the base rate."""
    clean = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    out = clean.groupBy(*group).agg(
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"), F.avg(label).alias("__y"))
    reference = F.col("__y") * (1 - F.col("__y"))
    return out.select(*group, "brier", (1 - F.col("brier") / F.nullif(reference, F.lit(0.0))).alias("brier_skill_score"))


def precision_at_k(df: DataFrame, group: list[str], k: int = 20, *, tie_break: str = "symbol",
                   score: str = "probability", label: str = "label") -> DataFrame:
    """(group, n, precision_at_k, base_rate): share of events among the k highest scores."""
    clean = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    base = clean.groupBy(*group).agg(F.count("*").alias("n"), F.avg(label).alias("base_rate"))
    best = top_k(clean.select(*group, score, label, tie_break), group, [F.desc(score), F.col(tie_break)], k)
    hit = best.groupBy(*group).agg(F.avg(label).alias("precision_at_k"))
    return join_groups(base, hit, group)


def calibration_bins(df: DataFrame, group: list[str], n_bins: int = 10, score: str = "probability",
                     label: str = "label") -> DataFrame:
    """Quantile bins: mean score against event rate; empty bins are absent."""
    clean = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    edges = {f"e{i}": i / n_bins for i in range(1, n_bins)}
    cuts = quantiles(clean.select(*group, score), group, score, edges)
    placed = join_groups(clean, cuts, group)
    slot = sum(((F.col(e) < F.col(score)).cast("int") for e in edges), F.lit(0))
    return placed.groupBy(*group, slot.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_probability"), F.avg(label).alias("event_rate"))


def rank_groups(df: DataFrame, group: list[str], value: str, n_groups: int, tie_break: str = "symbol",
                out: str = "band") -> DataFrame:
    """Equal-count bands 1..n_groups inside each group, 1 = lowest; ties go by ``tie_break``.

    ceil(rank / n * g) is not ntile: they differ when g does not divide n.
    """
    placed = positions(df, group, [value, tie_break], "__pos", "__n")
    band = F.ceil(F.col("__pos").cast("double") / F.col("__n") * n_groups)
    return placed.withColumn(out, F.least(F.greatest(band, F.lit(1)), F.lit(n_groups)).cast("int")).drop("__pos", "__n")


def percent_rank_avg(counts: DataFrame, group: list[str], weight: str = "n") -> DataFrame:
    """Add ``pct_rank``: average rank of ties divided by the group size, per distinct score."""
    ranked = running(counts, group, ["score"], {"__end": F.col(weight)})
    mean_rank = F.col("__end") - F.col(weight) + (F.col(weight) + 1) / 2
    return ranked.withColumn("pct_rank", mean_rank / F.col("__end_total")).drop("__end", "__end_total")


def evaluate_all(df: DataFrame, group: list[str], *, k: int = 20, min_rows: int = 10,
                 date: str = "observation_date") -> DataFrame:
    """One row per group with every metric. Accuracy is left out on purpose."""
    out = auc_spread(within_date_auc(df, group, date, min_rows=min_rows), group)
    at_k = precision_at_k(df, [*group, date], k).groupBy(*group).agg(F.avg("precision_at_k").alias(f"precision_at_{k}"))
    base = df.groupBy(*group).agg(F.avg("label").alias("base_rate"))
    for part in (pooled_auc(df, group), average_precision(df, group), base, at_k, brier(df, group)):
        out = join_groups(out, part, group, "left")
    return out


def histogram(df: DataFrame, group: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, lower, upper, n) over fixed edges; the last bin is closed, empty bins count 0."""
    v = F.col(value)
    step = (high - low) / bins
    slot = F.least(F.floor((v - low) / F.lit(step)).cast("int"), F.lit(bins - 1))
    counted = df.where(v.between(low, high)).groupBy(*group, slot.alias("bin")).agg(F.count("*").alias("n"))
    every = (df.select(*group).distinct() if group else df.sparkSession.range(1).select()).select(
        *group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return join_groups(every, counted, [*group, "bin"], "left").select(
        *group, "bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def linear_fit(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept; NULL below two rows or two distinct x."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ok = (F.count("*") >= 2) & (F.min(x) < F.max(x))
    return both.groupBy(*group).agg(
        F.count("*").alias("n"), F.when(ok, F.regr_slope(y, x)).alias("slope"),
        F.when(ok, F.regr_intercept(y, x)).alias("intercept"))


def median(column: Column) -> Column:
    """For inputs a model or date count bounds, such as one value per fold."""
    return F.percentile(column, F.lit(0.5))
