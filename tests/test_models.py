"""Preprocessing, training, scoring and attribution."""

import itertools
import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pitpanel.operators import attribution, merge, metrics, power
from pitpanel.plans import prep, scoring, training
from pitpanel.registered import QUERIES, models as registered, panels, scalars
from pitpanel.session import materialise, scratch_path
from pitpanel.settings import ALL_FEATURES, EXPERIMENTS, MODELS, ModelSpec, Settings

SETTINGS = replace(Settings(), min_train_dates=8)
LOGREG = ModelSpec("logreg", "logreg", {"C": 1.0, "max_iter": 30, "balanced": True})
BOOSTED = ModelSpec("xgboost", "boosted", {"max_depth": 3, "n_estimators": 3, "learning_rate": 0.3, "subsample": 1.0,
                                           "colsample_bytree": 1.0, "min_child_weight": 5})
FEATURES = ["volatility_90d", "log_turnover_90d", "signal", "sham"]


@pytest.fixture(scope="module")
def panel(spark):
    """Twelve dates of sixty companies; ``signal`` carries the label, ``sham`` does not."""
    rng = np.random.default_rng(11)
    n, dates = 60, 12
    rows = []
    for d in range(dates):
        label = (rng.random(n) < 0.35).astype(int)
        rows.append(pd.DataFrame({
            "symbol": [f"s{i:02d}" for i in range(n)], "observation_date": pd.Timestamp("2021-01-31") + pd.DateOffset(months=3 * d),
            "label": label, "label_is_valid": 1, "is_stale": 0, "volatility_90d": rng.random(n), "log_turnover_90d": rng.random(n),
            "signal": label * 1.2 + rng.normal(0, 1, n), "sham": rng.normal(0, 1, n)}))
    frame = pd.concat(rows)
    frame.loc[frame.index % 9 == 0, "sham"] = np.nan
    df = spark.createDataFrame(frame).withColumn("observation_date", F.to_date("observation_date"))
    return materialise(df.withColumn("sham", F.when(~F.isnan("sham"), F.col("sham"))), "panel")


def test_preprocessing_equals_numpy(panel):
    fitted = prep.fit(panel, FEATURES)
    x = panel.toPandas()["sham"].to_numpy()
    known = x[~np.isnan(x)]
    low, high = np.quantile(known, [0.01, 0.99])
    clip = np.clip(x, low, high)
    fill = np.nanmedian(clip)
    full = np.where(np.isnan(clip), fill, clip)
    s = fitted.stats["sham"]
    assert (s.low, s.high, s.fill, s.mean, s.std) == pytest.approx((low, high, fill, full.mean(), full.std()))
    assert fitted.indicators == ["sham_missing"]
    with pytest.raises(ValueError, match="missing"):
        prep.fit(panel, ["nope"])


def test_all_unknown_feature_is_left_alone(panel):
    empty = panel.withColumn("void", F.lit(None).cast("double"))
    s = prep.fit(empty, ["void"]).stats["void"]
    assert (s.low, s.high, s.fill, s.std) == (None, None, 0.0, 1.0)


def test_statistics_of_all_folds_equal_each_fold(panel):
    odd = panel.withColumn("void", F.lit(None).cast("double")).withColumn("same", F.lit(3.0)).withColumn(
        "late", F.when(F.col("observation_date") > "2022-06-30", F.col("sham")))
    names = [*FEATURES, "void", "same", "late"]
    plan = training.plan_folds(odd, SETTINGS)
    known = training.fold_stats(odd, plan, names, SETTINGS)
    for k, fold in enumerate(plan):
        train = odd.where(F.col("observation_date") <= F.lit(fold["train_through"]))
        alone = prep.fit(train, names)
        assert known.counts[k] == (train.count(), train.where("label = 1").count())
        assert known.ready[k].names == alone.names
        for f in names:
            for part, value in vars(alone.stats[f]).items():
                assert getattr(known.ready[k].stats[f], part) == (None if value is None else pytest.approx(value, abs=1e-12)), (f, part)


def test_folds_at_once_do_not_share_properties(panel):
    plan = training.plan_folds(panel, SETTINGS)
    stats = training.fold_stats(panel, plan, FEATURES[:2], SETTINGS)
    runs = [training.walk_forward(panel, plan, FEATURES[:2], LOGREG, SETTINGS, stats=stats).oof.count() for _ in range(5)]
    assert runs == [4 * 60] * 5


@pytest.fixture(scope="module")
def oof(panel):
    plan = training.plan_folds(panel, SETTINGS)
    runs = {name: training.walk_forward(panel, plan, feats, LOGREG, SETTINGS)
            for name, feats in (("null", FEATURES[:2]), ("signal", FEATURES[:3]), ("sham", FEATURES[:2] + ["sham"]))}
    assert all(r.skipped == [] for r in runs.values())
    frames = [r.oof.select(F.lit("logreg").alias("model"), F.lit(n).alias("experiment"), "*") for n, r in runs.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def test_positive_control(spark, oof):
    pairs = spark.createDataFrame([("signal", "null"), ("sham", "null")], "experiment string, baseline string")
    got = {r.experiment: r for r in power.paired_delta(
        metrics.within_date_auc(oof, ["model", "experiment"]), pairs, ["model"], n_bootstrap=500).collect()}
    assert got["signal"].verdict == "POSITIVE" and got["signal"].delta > 0.1
    assert got["sham"].verdict != "POSITIVE"


def test_every_test_row_is_scored_once(panel, oof):
    one = oof.where("experiment = 'null'")
    assert one.count() == 4 * 60 == one.select("symbol", "observation_date").distinct().count()


def test_shuffled_labels_lose_the_signal(panel):
    gate = training.shuffle_gate(panel, FEATURES[:3], LOGREG, SETTINGS, repeats=1)
    assert abs(gate["mean"] - 0.5) < 0.12


def test_single_class_is_skipped(panel):
    assert training.fit(panel.where("label = 1"), FEATURES, LOGREG, SETTINGS) is None


def test_search_points_are_distinct(spark):
    spec = ModelSpec("x", "boosted", {}, {"a": [1, 2, 3], "b": [0.1, 0.2, 0.3, 0.4]})
    points = training.search_points(spark, spec, 5, 42)
    assert len({tuple(p.items()) for p in points}) == 5 and points == training.search_points(spark, spec, 5, 42)
    assert len(training.search_points(spark, spec, 99, 42)) == 12


def _fits(spark, panel, monkeypatch, name):
    """The registered query's result and what each of its fits is asked for; nothing is fitted."""
    asked = []

    def fit_fold(rows, fold, features, spec, settings, overrides=None, ready=None, counts=None):
        asked.append((tuple(features), spec, rows.count(), fold["fold"], overrides or {}))
        test = rows.where(F.col("observation_date") == F.lit(fold["test_date"]))
        return test.select("symbol", "observation_date", "label", F.lit(0.5).alias("probability"), F.lit(fold["fold"]).alias("fold"))

    wide = panel.select("symbol", "observation_date", "label", "label_is_valid", *[
        F.when(F.col("symbol") != f"s{i:02d}", F.col("signal") * 4 + i).alias(f) for i, f in enumerate(ALL_FEATURES)])
    frame = materialise(wide, "wide")
    monkeypatch.setattr(registered, "stored_panel", lambda spark, sf: frame)
    monkeypatch.setattr(training, "fit_fold", fit_fold)
    return QUERIES[name](spark, "").collect(), asked


def test_the_search_takes_every_point_of_the_settings(spark, panel, monkeypatch):
    rows, asked = _fits(spark, panel, monkeypatch, "random_search")
    spec = next(m for m in MODELS if m.name == Settings().search_model)
    points = training.search_points(spark, spec, Settings().search_points, Settings().seed)
    assert len(rows) == len(asked) == Settings().search_points == 20
    assert sorted(asked, key=str) == sorted(((EXPERIMENTS[2].features, spec, panel.count(), Settings().search_fold, p) for p in points), key=str)
    assert [{a: r[a] for a in spec.search_space} for r in sorted(rows, key=lambda r: r["point"])] == points


def test_the_ladder_fits_every_experiment_with_every_model(spark, panel, monkeypatch):
    rows, asked = _fits(spark, panel, monkeypatch, "train_ladder")
    runs = {(m.name, e.name) for e in EXPERIMENTS for m in MODELS}
    assert len(runs) == 30 and {(r["model"], r["experiment"]) for r in rows} == runs
    wanted = {(e.features, m.name, k) for e in EXPERIMENTS for m in MODELS for k in range(4)}
    assert len(asked) == 30 * 4 and {(f, spec.name, k) for f, spec, _, k, _ in asked} == wanted
    assert all(spec in MODELS and not overrides for _, spec, _, _, overrides in asked)
    smaller = Counter(f for f, _, n, _, _ in asked if n < panel.count())
    assert smaller == {e.features: 3 * 4 for e in EXPERIMENTS if e.population == "pledged"}


@pytest.fixture(scope="module")
def boosted(spark, panel):
    fitted = training.fit(panel, FEATURES, BOOSTED, SETTINGS)
    path = scratch_path(spark, "booster")
    fitted.pipeline.stages[-1].write().save(path)
    return fitted, materialise(attribution.leaf_paths(spark, path), "paths")


def test_tree_contributions_add_up_to_the_margin(panel, boosted):
    fitted, paths = boosted
    rows = fitted.pipeline.transform(panel).select(
        "symbol", "observation_date", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    shap = attribution.tree_contributions(rows, paths, list(fitted.names), ["symbol", "observation_date"])
    base = attribution.tree_base_value(paths).first().base
    total = shap.groupBy("symbol", "observation_date").agg(F.sum("shap_value").alias("s")).join(rows, ["symbol", "observation_date"]).collect()
    assert len(total) == 720
    for r in total[:200]:
        assert 1 / (1 + math.exp(-2 * (base + r.s))) == pytest.approx(r.p[1], abs=1e-9)


@pytest.mark.parametrize("spec,scale", [
    (ModelSpec("deep", "boosted", BOOSTED.params | {"max_depth": 8, "min_child_weight": 1}), "margin"),
    (ModelSpec("forest", "random_forest", {"n_estimators": 5, "max_depth": 7, "min_samples_leaf": 2}), "probability")])
def test_deep_trees_and_forests_add_up(spark, panel, spec, scale):
    fitted = training.fit(panel, FEATURES, spec, SETTINGS)
    path = scratch_path(spark, "trees")
    fitted.pipeline.stages[-1].write().save(path)
    paths = materialise(attribution.leaf_paths(spark, path), "paths")
    model = fitted.pipeline.stages[-1]
    assert paths.count() == sum((t.numNodes + 1) // 2 for t in model.trees) and max(t.depth for t in model.trees) > 5
    rows = fitted.pipeline.transform(panel.where("symbol < 's20'")).select(
        "symbol", "observation_date", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    shap = attribution.tree_contributions(rows, paths, list(fitted.names), ["symbol", "observation_date"])
    base = attribution.tree_base_value(paths).first().base
    for r in shap.groupBy("symbol", "observation_date").agg(F.sum("shap_value").alias("s")).join(rows, ["symbol", "observation_date"]).collect():
        total = base + r.s
        assert (1 / (1 + math.exp(-2 * total)) if scale == "margin" else total) == pytest.approx(r.p[1], abs=1e-9)


def test_tree_contributions_equal_brute_force(panel, boosted):
    fitted, paths = boosted
    row = fitted.pipeline.transform(panel.orderBy("symbol", "observation_date").limit(1)).select(
        "symbol", "observation_date", vector_to_array("features").alias("x"))
    got = {r.feature_name: r.shap_value for r in attribution.tree_contributions(
        row, paths, list(fitted.names), ["symbol", "observation_date"]).collect()}
    x = row.first().x
    want = dict.fromkeys(fitted.names, 0.0)
    for leaf in paths.collect():
        parts = {p.feature: (all((x[c.feature] <= c.threshold) == c.left for c in p.conds), p.share) for p in leaf.parts}
        value = lambda s: leaf.leaf * math.prod(float(f) if k in s else z for k, (f, z) in parts.items())  # noqa: B023, E731
        m = len(parts)
        for me in parts:
            others = [k for k in parts if k != me]
            for size in range(m):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    want[fitted.names[me]] += w * (value({*s, me}) - value(set(s)))
    for name, v in want.items():
        assert got.get(name, 0.0) == pytest.approx(v, abs=1e-12)


def test_linear_contributions_work_the_windows_out_once(spark, sf, monkeypatch):
    stored = []
    monkeypatch.setattr(scalars, "materialise", lambda df, name: stored.append(df) or materialise(df, name))
    rows = QUERIES["attrib_linear"](spark, sf).collect()
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("filter(all_trade_date")
    alone = panels.panel(spark, sf, stored[0].columns)
    assert searches(stored[0]) == searches(alone) > 0
    full = alone.dropna(subset=list(scalars._COEF))
    assert sorted((r["symbol"], r["observation_date"]) for r in rows) == sorted(3 * [tuple(r) for r in full.select("symbol", "observation_date").collect()])


def test_linear_contributions_need_a_population(panel):
    one = panel.limit(1)
    alone = attribution.linear_contributions(one, one, {"signal": 2.0}, ["symbol"]).first().shap_value
    among = attribution.linear_contributions(one, panel, {"signal": 2.0}, ["symbol"]).first().shap_value
    assert alone == 0.0 and among != 0.0


def test_scoring(spark, panel):
    fitted = training.fit(panel, FEATURES, LOGREG, SETTINGS)
    path = scratch_path(spark, "model")
    run = training.register(fitted, path, "r", "e", SETTINGS).first()
    assert run.feature_list == FEATURES and run.n_train_rows == 720
    with pytest.raises(ValueError, match="stored model"):
        training.check_features(fitted.pipeline, ["other"])
    from pyspark.ml import PipelineModel

    runs = training.register(fitted, path, "r", "e", SETTINGS).unionByName(
        training.register(fitted, scratch_path(spark, "model"), "other", "e", SETTINGS))
    for wrong in (runs, runs.withColumn("is_active", F.lit(1)), merge.set_single_active(runs, "unknown")):
        with pytest.raises(Exception, match="no active run|2 active runs|unknown run"):
            training.load_active(wrong)
    active = merge.set_single_active(runs, "r")
    with pytest.raises(ValueError, match="stored model"):
        training.load_active(active.withColumn("feature_list", F.array(F.lit("signal"))))
    key = ["run_id", "symbol", "probability"]
    assert sorted(scoring.score_active(active, panel).select(key).collect()) == sorted(
        scoring.score_date(fitted.pipeline, panel, FEATURES, "r").select(key).collect())
    loaded = PipelineModel.load(path)
    scored = materialise(scoring.score_date(loaded, panel, FEATURES, "r"), "scored")
    assert scored.count() == 60 and {r["count"] for r in scored.groupBy("risk_decile").count().collect()} == {6}
    assert scored.where("sham IS NULL AND size(warnings) = 0").count() == 0
    day = scored.first().observation_date
    stored = scored.select("run_id", "symbol", "observation_date", "probability", F.lit("backtest").alias("source"))
    assert scoring.replace_slice(stored, scored, "r", day).count() == 60
    vector = F.create_map(*[c for f in FEATURES for c in (F.lit(f), F.coalesce(F.col(f), F.lit(0.0)))])
    ok = scoring.score_vectors(loaded, panel.limit(3).select(vector.alias("vector")), FEATURES).collect()
    assert all(0 < r.probability < 1 and r.risk_decile is None for r in ok)
    short = spark.createDataFrame([({"signal": 1.0},)], "vector map<string,double>")
    with pytest.raises(Exception, match="missing required features"):
        scoring.score_vectors(loaded, short, FEATURES).collect()
    odd = panel.limit(1).select(F.map_concat(vector, F.create_map(F.lit("pledge_max_4q"), F.lit(-5.0))).alias("vector"))
    with pytest.raises(Exception, match="below the minimum"):
        scoring.score_vectors(loaded, odd, FEATURES).collect()


def test_sentences(spark):
    rec = spark.createDataFrame([(1, "volatility_90d", 0.42, 0.3), (1, "pledge_accel", None, -0.2), (1, "pledge_accel_missing", None, 0.05)],
                                "id int, feature_name string, feature_value double, shap_value double")
    scored = spark.createDataFrame([(1, 0.61, 9, "CRITICAL")], "id int, probability double, risk_decile int, risk_band string")
    got = attribution.sentences(rec, scored, ["id"]).first().summary
    assert got == ("CRITICAL (probability 0.61, decile 9). Raised by: 90-day volatility 42% (+0.30). "
                   "Lowered by: pledge_accel was unavailable (-0.15).")


def test_fold_statistics_stay_narrow_however_many_folds(spark, monkeypatch):
    """Each fold's numbers are those of a fit of its own rows, and what is stored does not widen with the folds."""
    days = pd.date_range("2001-01-01", periods=20).date
    rng = np.random.default_rng(5)
    rows = [(days[i % 20], float(rng.normal()), float(i % 3), 7.25, None if i % 20 < 6 else float(i), None) for i in range(3000)]
    rows += [(None, 1e9, 1e9, 1e9, 1e9, 1e9), (days[0], None, None, None, None, None)]
    names = ["wide", "ties", "constant", "late", "never"]
    df = spark.createDataFrame(rows, "observation_date date, " + ", ".join(f"{c} double" for c in names))
    ends, stored = list(days[2:]), []
    monkeypatch.setattr(prep, "materialise", lambda frame, name: stored.append(frame.columns) or materialise(frame, name))
    monkeypatch.setattr(prep, "BLOCK", 64)
    folds = prep.fit_folds(df, names, ends)
    assert len(folds) == 18 and max(len(c) for c in stored) <= 6
    for k in (3, 17):
        alone = prep.fit(df.where(F.col("observation_date") <= F.lit(ends[k])), names)
        assert folds[k].indicators == alone.indicators
        for f in names:
            got, want = vars(folds[k].stats[f]), vars(alone.stats[f])
            assert got == {c: v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for c, v in want.items()}, (k, f)
