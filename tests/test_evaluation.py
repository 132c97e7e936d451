"""Intervals, ceilings, backtests and sweeps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import backtest, metrics, power, runs, sensitivity
from pitpanel.registered.panels import panel
from pitpanel.session import materialise
from pitpanel.settings import EXPERIMENTS
from pitpanel.sources import adapters as src


def oof(spark, signals, dates=8, n=40, seed=0):
    """Scores per experiment: signal x label + noise."""
    rng = np.random.default_rng(seed)
    frames = []
    label = (rng.random((dates, n)) < 0.3).astype(int)
    noise = rng.random((dates, n))
    for name, signal in signals.items():
        p = signal * label + (1 - signal) * noise
        frames += [pd.DataFrame({"experiment": name, "observation_date": f"2023-{d + 1:02d}", "symbol": range(n),
                                 "label": label[d], "probability": p[d]}) for d in range(dates)]
    return spark.createDataFrame(pd.concat(frames)).withColumn("model", F.lit("m"))


def paired(spark, df, a="b", b="a"):
    pairs = spark.createDataFrame([(a, b)], "experiment string, baseline string")
    return power.paired_delta(metrics.within_date_auc(df, ["model", "experiment"]), pairs, ["model"], n_bootstrap=500).first()


def test_identical_runs_are_zero(spark):
    got = paired(spark, oof(spark, {"a": 0.2, "b": 0.2}))
    assert got.delta == 0 and got.verdict == "ZERO" and got.ci_low == 0 == got.ci_high


def test_a_real_gain_is_positive_and_its_mirror_negative(spark):
    df = oof(spark, {"a": 0.0, "b": 0.3})
    assert paired(spark, df).verdict == "POSITIVE" and paired(spark, df, "a", "b").verdict == "NEGATIVE"


def test_dates_scored_by_one_side_only_are_listed(spark):
    df = oof(spark, {"a": 0.1, "b": 0.2}).where("experiment = 'a' OR observation_date <> '2023-03'")
    got = paired(spark, df)
    assert got.n_dates == 7 and got.dropped_dates == "2023-03"


def test_one_date_is_unknown(spark):
    got = paired(spark, oof(spark, {"a": 0.1, "b": 0.2}, dates=1))
    assert got.verdict == "UNKNOWN" and got.delta is None


def test_interval_agrees_with_theory(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.02, 0.05, 25)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "d": range(25), "v": x}))
    got = power.bootstrap_t_interval(df, ["k"], "d", "v", n_bootstrap=4000).first()
    half = 2.064 * x.std(ddof=1) / 5
    assert got.theta == pytest.approx(x.mean())
    assert got.ci_low == pytest.approx(x.mean() - half, abs=0.25 * half)
    assert got.ci_high == pytest.approx(x.mean() + half, abs=0.25 * half)
    plain = power.bootstrap_percentile_interval(df, ["k"], "d", "v", n_bootstrap=4000).first()
    assert plain.ci_high - plain.ci_low < got.ci_high - got.ci_low


@pytest.mark.parametrize("visible,ceiling_auc,binding", [(False, None, True), (True, 1.0, False)])
def test_oracle_sees_nothing_or_everything(spark, visible, ceiling_auc, binding):
    df = oof(spark, {"a": 0.1}).withColumn("visible", F.lit(visible))
    got = power.oracle_ceiling(df, ["experiment"]).first()
    assert got.coverage == float(visible) and got.ceiling_binding == binding
    assert got.ceiling == pytest.approx(0.0 if ceiling_auc is None else 1.0 - got.baseline_auc)


def test_oracle_is_monotone_in_coverage(spark):
    df = oof(spark, {"a": 0.1})
    some = power.oracle_ceiling(df.withColumn("visible", F.col("symbol") < 10), ["experiment"]).first().ceiling
    more = power.oracle_ceiling(df.withColumn("visible", F.col("symbol") < 20), ["experiment"]).first().ceiling
    assert 0 < some < more


def test_mask_is_joined_by_key(spark):
    df = oof(spark, {"a": 0.1}).orderBy(F.rand(1))
    mask = df.select("symbol", "observation_date", F.when(F.col("symbol") == 7, 2.0).otherwise(0.0).alias("f"))
    seen = power.visible_rows(df, mask.where("symbol <> 9"), ["f", "absent"], ["symbol", "observation_date"])
    assert {r.symbol for r in seen.where("visible").collect()} == {7} and seen.count() == df.count()


def test_backtest_of_a_perfect_ranking(spark):
    df = oof(spark, {"a": 0.999})
    got = backtest.summary(backtest.quintile_table(df, ["experiment"]), ["experiment"]).first()
    assert got.q5_event_rate > 0.9 and got.q1_event_rate == 0.0 and got.separation_ratio is None
    assert got.n_dates_ratio_undefined == 8 and got.monotonic


@pytest.fixture(scope="module")
def labelled(spark, sf):
    return materialise(panel(spark, sf).where("label_is_valid = 1"), "panel")


def test_wider_windows_cover_more_and_cuts_add_up(spark, sf, labelled):
    windows = sensitivity.window_sweep(src.events(spark, sf), labelled).orderBy("window_days").toPandas()
    assert windows.coverage.is_monotonic_increasing and windows.configured.sum() == 1
    cuts = sensitivity.materiality_sweep(src.events(spark, sf), labelled).orderBy("min_pct_equity").toPandas()
    total = src.events(spark, sf).count()
    assert set(cuts.events_kept + cuts.events_dropped) == {total} and cuts.events_kept.is_monotonic_decreasing


def test_univariate_mirror(labelled):
    got = sensitivity.univariate_table(labelled, ["volatility_90d", "return_90d", "absent"]).toPandas()
    assert len(got) == 2 and np.allclose(got.auc + got.auc_if_inverted, 1)


def session_rows(spark, active="20240101T0000_logreg_a"):
    ids = [f"2024010{d}T0000_{m}_a" for d in range(1, 6) for m in ("logreg", "xgboost")]
    return spark.createDataFrame([(i, i[:8], int(i == active)) for i in ids], "run_id string, created_at string, is_active int")


def test_retention_keeps_newest_and_active(spark):
    got = {r.session for r in runs.superseded_sessions(runs.sessions(session_rows(spark)), keep=2).collect()}
    assert got == {"20240102T0000", "20240103T0000"}


def test_retention_of_zero_deletes_nothing(spark):
    assert runs.superseded_sessions(runs.sessions(session_rows(spark)), keep=0).count() == 0


def test_pruning_takes_children_along(spark):
    r = session_rows(spark)
    p = r.select(F.xxhash64("run_id").alias("prediction_id"), "run_id")
    e = p.select("prediction_id", F.lit("f").alias("feature_name"))
    left, gone = runs.prune_runs({"model_runs": r, "predictions": p, "explanations": e}, keep=2)
    assert {x.table: x.deleted for x in gone.collect()} == {"model_runs": 4, "predictions": 4, "explanations": 4}
    assert {n: df.count() for n, df in left.items()} == {"model_runs": 6, "predictions": 6, "explanations": 6}


def test_ties_go_to_the_simpler_model_and_no_active_run_is_an_error(spark):
    auc = spark.createDataFrame([("s", "xgboost", "e", 0.70), ("s", "logreg", "e", 0.70), ("s", "random_forest", "e", 0.6)],
                                "session string, model_name string, experiment string, metric_value double")
    assert runs.select_best(auc, ["session"], "e").first().model_name == "logreg"
    with pytest.raises(Exception, match="no active run"):
        runs.require_active_run(session_rows(spark, active="x")).collect()


def test_feature_difference(spark):
    got = {r.experiment: r.n_extra for r in runs.extra_features(spark, EXPERIMENTS).collect()}
    assert got["expB_full"] == 11 and "exp0_null" not in got and got["expG_pledged_full"] == 11
