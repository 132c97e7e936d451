"""Paired differences, resampled intervals and oracle ceilings.

The unit of resampling is the date, so the arrays here are as long as the calendar has observation
dates. Draws come from md5 of (draw, position, seed): they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.scalars import verdict
from pitpanel.operators.metrics import auc_from_counts, percent_rank_avg, with_skip_reason
from pitpanel.session import materialise

_BLOCK = 500


def draw_index(draw: Column, position: Column, seed: int, n: Column) -> Column:
    text = F.concat_ws("-", draw.cast("string"), position.cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def _samples(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, n, theta, sd, vals): one row per comparison with its values in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    return values.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("theta"), F.stddev_samp(value).alias("sd"),
        F.transform(rows, lambda x: x.getField(value)).alias("vals"))


def resampled_means(samples: DataFrame, keys: list[str], n_bootstrap: int, seed: int) -> DataFrame:
    """One row per (comparison, draw) with the mean and sample deviation of the resample; a resample of one value has no deviation.

    Each draw folds its values inside its own row, by running means, so a resample without spread has deviation 0 exactly.
    Draws are dealt out in blocks, so the work spreads over tasks although it starts from one row per comparison.
    """
    blocks = (n_bootstrap + _BLOCK - 1) // _BLOCK
    dealt = samples.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(*keys, "block")
    low = F.col("block") * _BLOCK
    high = F.least(low + _BLOCK - 1, F.lit(n_bootstrap - 1))
    draws = dealt.withColumn("draw", F.explode(F.sequence(low, high)))
    picked = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1),
                         lambda i: F.get(F.col("vals"), draw_index(F.col("draw"), i, seed, F.col("n"))))

    def add(acc, x):
        k, off = acc["k"] + 1, x - acc["m"]
        mean = acc["m"] + off / k
        return F.struct(k.alias("k"), mean.alias("m"), (acc["q"] + off * (x - mean)).alias("q"))

    empty = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    folded = draws.select(*keys, "draw", "n", "theta", "sd", F.aggregate(picked, empty, add).alias("r"))
    return folded.select(*keys, "draw", "n", "theta", "sd", F.col("r.m").alias("m"),
                         F.when(F.col("n") > 1, F.sqrt(F.col("r.q") / (F.col("n") - 1))).alias("s"))


def bootstrap_t_interval(values: DataFrame, keys: list[str], order: str, value: str, *, n_bootstrap: int = 10_000,
                         seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Studentised interval of a mean: (keys, n, theta, std_error, ci_low, ci_high).

    Crossed quantiles; a zero standard error gives the point itself; resamples without spread are
    dropped, and with fewer than two left the normal interval stands in. Each quantile is over
    ``n_bootstrap`` numbers, a parameter.
    """
    samples = _samples(values, keys, order, value)
    means = resampled_means(samples, keys, n_bootstrap, seed)
    root = F.sqrt("n")
    spread = F.col("s") / root
    t = F.when(spread > 1e-12, (F.col("m") - F.col("theta")) / spread)
    tail = (1.0 - confidence) / 2.0
    quantile = means.groupBy(*keys).agg(
        F.percentile(t, F.lit(1.0 - tail)).alias("t_high"), F.percentile(t, F.lit(tail)).alias("t_low"),
        F.count(t).alias("usable"))
    se = F.col("sd") / root
    flat, few = se <= 1e-12, F.col("usable") < 2
    return samples.join(quantile, keys).select(
        *keys, "n", "theta", se.alias("std_error"),
        F.when(flat, F.col("theta")).when(few, F.col("theta") - 1.96 * se)
        .otherwise(F.col("theta") - F.col("t_high") * se).alias("ci_low"),
        F.when(flat, F.col("theta")).when(few, F.col("theta") + 1.96 * se)
        .otherwise(F.col("theta") - F.col("t_low") * se).alias("ci_high"))


def bootstrap_percentile_interval(values: DataFrame, keys: list[str], order: str, value: str, *,
                                  n_bootstrap: int = 10_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Plain quantiles of the resampled means; for comparison only."""
    tail = (1.0 - confidence) / 2.0
    means = resampled_means(_samples(values, keys, order, value), keys, n_bootstrap, seed)
    return means.groupBy(*keys).agg(
        F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1.0 - tail)).alias("ci_high"))


def paired_dates(detail: DataFrame, pairs: DataFrame, by: list[str], date: str = "observation_date") -> DataFrame:
    """(by, experiment, baseline, date, treatment, control): full outer, so one-sided dates stay visible.

    ``detail``: (by, experiment, date, auc); ``pairs``: (experiment, baseline).
    """
    scored = detail.where(F.col("auc").isNotNull())
    ours = scored.join(F.broadcast(pairs), "experiment").select(
        *by, "experiment", "baseline", date, F.col("auc").alias("treatment"))
    theirs = scored.withColumnRenamed("experiment", "baseline").join(F.broadcast(pairs), "baseline").select(
        *by, "experiment", "baseline", date, F.col("auc").alias("control"))
    return ours.join(theirs, [*by, "experiment", "baseline", date], "full_outer")


def paired_delta(detail: DataFrame, pairs: DataFrame, by: list[str], *, n_bootstrap: int = 10_000, seed: int = 42,
                 confidence: float = 0.95, date: str = "observation_date") -> DataFrame:
    """Interval and verdict for treatment - control over the dates both sides scored."""
    both = paired_dates(detail, pairs, by, date)
    keys = [*by, "experiment", "baseline"]
    # One row per (comparison, date), read by three branches below.
    diff = materialise(both.withColumn("delta", F.col("treatment") - F.col("control")), "paired-dates")
    shared = diff.where(F.col("delta").isNotNull())
    counts = diff.groupBy(*keys).agg(
        F.count("delta").alias("n_dates"), F.avg("delta").alias("delta"),
        F.count_if(F.col("delta") > 0).alias("dates_better"), F.count_if(F.col("delta") < 0).alias("dates_worse"),
        F.count_if(F.col("delta").isNull()).alias("n_dropped"),
        F.array_join(F.array_sort(F.collect_list(
            F.when(F.col("delta").isNull(), F.col(date).cast("string")))), ",").alias("dropped_dates"))
    interval = bootstrap_t_interval(shared, keys, date, "delta", n_bootstrap=n_bootstrap, seed=seed,
                                    confidence=confidence).drop("n", "theta")
    joined = counts.join(interval, keys, "left")
    enough = F.col("n_dates") >= 2
    low, high = F.when(enough, F.col("ci_low")), F.when(enough, F.col("ci_high"))
    return joined.select(
        *keys, "n_dates", F.when(enough, F.col("delta")).alias("delta"),
        F.when(enough, F.col("std_error")).alias("sd"), low.alias("ci_low"), high.alias("ci_high"),
        ((high - low) / 2).alias("half_width"), "dates_better", "dates_worse", "n_dropped", "dropped_dates",
        verdict(low, high).alias("verdict"))


def any_feature(columns: list[str], available: list[str]) -> Column:
    """True when a listed feature is present and not zero; unknown names are ignored."""
    seen = [F.coalesce(F.col(c) != 0, F.lit(False)) for c in columns if c in available]
    return F.greatest(*seen) if len(seen) > 1 else (seen[0] if seen else F.lit(False))


def visible_rows(control: DataFrame, panel: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """Control rows with ``visible``, joined by key, never by position; a missing key is not visible."""
    mask = panel.select(*key, any_feature(features, panel.columns).alias("visible"))
    return control.join(mask, key, "left").withColumn("visible", F.coalesce("visible", F.lit(False)))


def control_rows(oof: DataFrame, pairs: DataFrame, masks: DataFrame,
                 key: tuple[str, ...] = ("symbol", "observation_date")) -> DataFrame:
    """The baseline's rows once per experiment, with what that experiment can see."""
    control = oof.withColumnRenamed("experiment", "baseline").join(F.broadcast(pairs), "baseline")
    return control.join(masks, ["experiment", *key], "left").withColumn(
        "visible", F.coalesce("visible", F.lit(False)))


def oracle_ceiling(control: DataFrame, by: list[str], *, min_rows: int = 10,
                   date: str = "observation_date") -> DataFrame:
    """The largest gain if every visible row were ranked right: one row per ``by``.

    ``control``: (by, date, probability, label, visible). Ranks, offsets and both AUCs work on counts
    per distinct score, so equal scores never meet as rows.
    """
    keys = [*by, date]
    known = F.col("probability").isNotNull() & F.col("label").isNotNull()
    every = materialise(control.groupBy(*keys, F.when(known, F.col("probability")).alias("score")).agg(
        *[F.count_if((F.col("label") == y) & (F.col("visible") == F.lit(v))).alias(f"c{y}{int(v)}")
          for y in (0, 1) for v in (False, True)],
        F.count("*").alias("n"), F.count_if("visible").alias("seen")), "ceiling-cells")
    cells = every.where(F.col("score").isNotNull())
    ranked = materialise(percent_rank_avg(cells, keys), "ceiling-ranks")
    base = ranked.select(*keys, F.col("pct_rank").alias("score"), (F.col("c10") + F.col("c11")).alias("pos"), "n")
    moved = ranked.select(*keys, F.explode(F.array(
        F.struct(F.col("pct_rank").alias("score"), F.col("c10").alias("pos"), (F.col("c10") + F.col("c00")).alias("n")),
        F.struct((F.col("pct_rank") + 1).alias("score"), F.col("c11").alias("pos"), F.col("c11").alias("n")),
        F.struct((F.col("pct_rank") - 1).alias("score"), F.lit(0).cast("bigint").alias("pos"), F.col("c01").alias("n")),
    )).alias("__x")).select(*keys, "__x.*").where(F.col("n") > 0)
    moved = moved.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))

    def mean_auc(counts: DataFrame, name: str) -> DataFrame:
        return with_skip_reason(auc_from_counts(counts, keys), min_rows).groupBy(*by).agg(F.avg("auc").alias(name))

    cover = every.groupBy(*by).agg(
        (F.sum("seen") / F.sum("n")).alias("coverage"), F.sum("seen").alias("rows_visible"),
        F.sum("n").alias("rows_total"))
    out = cover.join(mean_auc(base, "baseline_auc"), by, "left").join(mean_auc(moved, "oracle_auc"), by, "left")
    return out.select(
        *by, "baseline_auc", "oracle_auc", (F.col("oracle_auc") - F.col("baseline_auc")).alias("ceiling"),
        "coverage", "rows_visible", "rows_total", (F.col("oracle_auc") < 1.0 - 1e-9).alias("ceiling_binding"))


def power_report(oof: DataFrame, pairs: DataFrame, masks: DataFrame, *, by: str = "model", n_bootstrap: int = 10_000,
                 seed: int = 42, confidence: float = 0.95, min_rows: int = 10) -> DataFrame:
    """Every experiment against its own baseline, per model: delta, interval, verdict, ceiling.

    ``oof``: (model, experiment, symbol, observation_date, label, probability); ``pairs``:
    (experiment, baseline); ``masks``: (experiment, symbol, observation_date, visible).
    """
    from pitpanel.operators.metrics import within_date_auc

    pairs = pairs.where(F.col("experiment") != F.col("baseline"))
    detail = within_date_auc(oof, [by, "experiment"], min_rows=min_rows)
    delta = paired_delta(detail, pairs, [by], n_bootstrap=n_bootstrap, seed=seed, confidence=confidence)
    ceiling = oracle_ceiling(control_rows(oof, pairs, masks), [by, "experiment", "baseline"], min_rows=min_rows)
    return delta.join(ceiling, [by, "experiment", "baseline"], "left")
