"""The time rule, quality rules and leak checks; every guard meets the violation it is for."""

import datetime as dt
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pitpanel.operators import events as ev, strata
from pitpanel.plans import folds, leakage, panel as plan, quality
from pitpanel.registered.panels import W, panel, state
from pitpanel.session import dealt, materialise
from pitpanel.settings import Population
from pitpanel.sources import adapters as src

D = dt.date


@pytest.fixture(scope="module")
def built(spark, sf):
    return materialise(panel(spark, sf), "panel")


def test_late_filing_is_blanked_and_the_row_stays(spark):
    grid = spark.createDataFrame([("A", D(2023, 3, 31), D(2023, 4, 30)), ("B", D(2023, 3, 31), D(2023, 4, 30))],
                                 "symbol string, quarter_end date, observation_date date")
    feats = spark.createDataFrame([("A", D(2023, 3, 31), D(2023, 4, 30), 5.0), ("B", D(2023, 3, 31), D(2023, 5, 1), 6.0)],
                                  "symbol string, quarter_end date, submission_date date, pledge_pct_promoter double")
    got = {r.symbol: r.pledge_pct_promoter for r in plan.point_in_time(grid, feats).collect()}
    assert got == {"A": 5.0, "B": None}
    with pytest.raises(ValueError):
        plan.point_in_time(grid, feats.drop("submission_date"))
    with pytest.raises(Exception, match="filed after"):
        plan.assert_point_in_time(grid.join(feats, ["symbol", "quarter_end"]), ["pledge_pct_promoter"]).collect()


def test_the_guard_runs_in_the_panel(spark, sf, monkeypatch):
    frame = panel(spark, sf)
    assert "filed after its observation date" in frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(plan, "blank_when", lambda df, condition, columns: df)  # what was filed late stays in
    with pytest.raises(Exception, match="filed after"):
        panel(spark, sf).agg(F.count("label")).collect()


def test_two_quarters_on_one_date_count_once(spark):
    seen = spark.createDataFrame([("A", D(2023, 6, 1))] * 2, "symbol string, observation_date date")
    events = spark.createDataFrame([("A", D(2023, 5, 1), "creation", 1.0)], "symbol string, event_date date, event_type string, pct_equity double")
    out = ev.event_features(seen, events).collect()
    assert [(r.event_created_90d, r.event_count_90d) for r in out] == [(1.0, 1.0)]


def test_all_checks_pass_on_the_panel(spark, sf, built):
    out = leakage.run_all(built, state(spark, sf), src.prices(spark, sf), horizon=W.horizon_bars,
                          folds=folds.fold_dates(built), events=src.events(spark, sf), strict=True).collect()
    assert len(out) == 4 and all(r.passed for r in out)
    assert all(r.rows_checked > 0 for r in out)


def test_planted_late_data_is_found(spark, sf, built):
    bad = built.withColumn("pledge_pct_promoter", F.coalesce("pledge_pct_promoter", F.lit(1.0)))
    assert leakage.submission_before_observation(bad, state(spark, sf)).first().violations > 0


def test_planted_window_shift_is_found(spark, sf, built):
    bad = built.withColumn("fwd_max_drawdown", F.least("fwd_max_drawdown", F.lit(0.0)))
    got = leakage.label_window_after_observation(bad, src.prices(spark, sf), W.horizon_bars).first()
    assert got.violations > 0 and not got.passed


def test_label_window_multiplies_no_label(spark):
    """Rows that repeat, bars without a price and labels near the end count as they did; the check explodes nothing."""
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    prices = spark.createDataFrame([(1, d, None if i == 7 else 10.0 - i) for i, d in enumerate(days)], "symbol int, trade_date date, adj_close double")
    labels = [(1, days[0], 1, -0.3), (1, days[1], 1, -0.5), (1, days[5], 1, -0.6), (1, days[10], 1, -0.1),
              (2, days[0], 1, -0.1), (None, days[0], 1, -0.1), (1, days[2], 1, -0.375), (1, days[2], 1, -0.375), (1, days[3], 0, None)]
    panel = spark.createDataFrame(labels, "symbol int, observation_date date, label_is_valid int, fwd_max_drawdown double")
    got = leakage.label_window_after_observation(panel, prices, 3)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert (got.first().rows_checked, got.first().violations) == (3, 1)


def test_planted_missing_buffer_is_found(spark, sf, built):
    from pitpanel.operators.events import event_features, filter_material

    naive = event_features(built, filter_material(src.events(spark, sf)), lag_days=0).select(
        "symbol", "observation_date", "event_count_90d")
    got = leakage.events_respect_lag(naive, src.events(spark, sf)).first()
    assert got.violations > 0 and got.naive_matches > 0


def test_planted_fold_overlap_is_found(spark):
    rows = [(0, D(2023, 1, 1), "train", 1, 0), (0, D(2023, 4, 1), "train", 1, 0), (0, D(2023, 4, 1), "test", 1, 0)]
    f = spark.createDataFrame(rows, "fold int, observation_date date, role string, n int, events int")
    assert leakage.folds_disjoint(f).first().violations == 1


def test_strict_run_raises(spark, sf, built):
    bad = built.withColumn("pledge_pct_promoter", F.lit(1.0))
    with pytest.raises(Exception, match="leakage check failed"):
        leakage.run_all(bad, state(spark, sf), src.prices(spark, sf), horizon=W.horizon_bars, strict=True).collect()


def test_folds_expand_and_skip_the_embargo(built):
    got = folds.describe_folds(folds.fold_dates(built, 8)).orderBy("fold").collect()
    assert [r.fold for r in got] == list(range(len(got)))
    assert all(a.n_train < b.n_train for a, b in zip(got, got[1:]))
    assert all(r.train_through < r.test_date for r in got)
    with pytest.raises(Exception, match="need more than"):
        folds.fold_dates(built, 500).collect()


def test_panel_counts_what_it_took_away(spark, sf):
    from dataclasses import replace

    from pitpanel.operators.bars import market_and_label
    from pitpanel.registered.panels import grid, traj
    from pitpanel.settings import MARKET_FEATURES

    w = replace(W, break_floor=-0.2)  # smoothed prices hardly break at the default
    parts = src.symbols(spark, sf).unionByName(spark.createDataFrame([(-5,)], "symbol long"), allowMissingColumns=True)
    seen = Observation("panel")
    rows = plan.build_panel(state(spark, sf), src.prices(spark, sf), src.benchmark(spark, sf), parts, src.quarter_array(), w, counts=seen)
    assert rows.columns == plan.PANEL_COLUMNS
    built = materialise(rows, "counted")
    got = seen.get
    places = plan.observation_grid(parts, src.quarter_array(), src.benchmark(spark, sf))
    as_they_are, cleared = [market_and_label(places, src.prices(spark, sf), src.benchmark(spark, sf), w, blank_breaks=b, void_breaks=b)
                            for b in (False, True)]
    cells = [df.select(sum(F.count(c) for c in MARKET_FEATURES)).first()[0] for df in (as_they_are, cleared)]
    labels = [df.agg(F.count("fwd_max_drawdown")).first()[0] for df in (as_they_are, cleared)]
    assert got["n_rows"] == built.count()
    assert got["cells_blanked"] == cells[0] - cells[1] > 0 and got["labels_voided"] == labels[0] - labels[1] > 0
    assert got["rows_without_bars"] == cleared.where("entry_price IS NULL").count() >= places.where("symbol = -5").count() > 0
    late = grid(spark, sf).join(traj(spark, sf), ["symbol", "quarter_end"]).where("submission_date > observation_date")
    assert got["rows_filed_late"] == late.count()


def test_shuffle_keeps_class_balance_and_nulls(built):
    mixed = materialise(leakage.permute_labels(built, 1), "mixed")
    count = lambda df: sorted(map(tuple, df.groupBy("observation_date").agg(
        F.sum("label"), F.count("label"), F.count("*")).collect()), key=str)
    assert count(built) == count(mixed)
    same = built.select("symbol", "observation_date", F.col("label").alias("a")).join(
        mixed.select("symbol", "observation_date", F.col("label").alias("b")), ["symbol", "observation_date"])
    assert same.where("(a IS NULL) <> (b IS NULL)").count() == 0
    assert same.where("a <> b").count() > 0


def test_validation_finds_planted_issues(built):
    assert quality.validate_panel(built).count() == 0
    bad = built.unionByName(built.limit(3)).withColumn("volatility_90d", F.when(F.col("symbol") == 1, F.lit(-1.0)).otherwise(F.col("volatility_90d")))
    found = {(r.column, r.rule) for r in quality.validate_panel(bad.drop("event_net_90d")).collect()}
    assert ("volatility_90d", "[0.0, None]") in found and ("symbol,observation_date", "unique") in found
    assert ("event_net_90d", "feature present") in found
    with pytest.raises(Exception, match="validation failed"):
        quality.validate_panel(bad, strict=True).collect()


def test_state_rows(spark):
    rows = [("A", "2023-03-31", "PLEDGE_PRESENT", 10.0, 50.0), ("B", "2023-03-31", "MAYBE", -1.0, 101.0)]
    df = spark.createDataFrame(rows, "symbol string, quarter_end string, pledge_status string, total_shares double, pledge_pct_equity double")
    got = {r.symbol: len(r.errors) for r in quality.state_row_errors(df).collect()}
    assert got == {"A": 0, "B": 3}


def test_stratum_leaves_unknown_values_out(built):
    pledged = Population("pledged", "pledge_pct_promoter", 1.0)
    asked = Population("asked", "pledge_pct_promoter", 1.0, include_missing=True)
    base = strata.apply_population(built, pledged, min_rows=0)
    assert base.where("pledge_pct_promoter IS NULL").count() == 0
    assert strata.apply_population(built, asked, min_rows=0).count() == base.count() + built.where("pledge_pct_promoter IS NULL").count()
    with pytest.raises(ValueError, match="labelled rows"):
        strata.apply_population(built, Population("none", "pledge_pct_promoter", 1e9))


def test_short_history_drops_the_never_observed(spark):
    rows = [("A", D(2023, 3, 31), 1.0), ("A", D(2023, 6, 30), 1.0), ("A", D(2023, 9, 30), 1.0), ("B", D(2023, 3, 31), 1.0), ("C", D(2023, 3, 31), None)]
    df = spark.createDataFrame(rows, "symbol string, quarter_end date, pledge_pct_promoter double")
    assert {r.symbol for r in plan.drop_short_history(df, 3).collect()} == {"A"}


def test_history_pages_hold_everything(spark, sf):
    pages = plan.entity_history(src.companies(spark, sf), state(spark, sf), src.events(spark, sf), src.predictions(spark, sf), panel(spark, sf, ["symbol", "observation_date", "label"]))
    assert pages.groupBy("symbol", "page").count().where("count > 1").isEmpty()
    assert pages.agg(F.sum(F.size("panel"))).first()[0] == panel(spark, sf, ["symbol", "observation_date", "label"]).distinct().count()
    copies = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x["copies"]))
    got = pages.agg(copies("events"), copies("predictions")).first()
    assert got[0] == src.events(spark, sf).count() and got[1] == src.predictions(spark, sf).count()


def test_history_rows_travel_once(spark, sf):
    filings = spark.createDataFrame([(1, "2001-01-31", 7), (1, "2001-01-31", 7), (1, None, 8), (None, "2001-01-31", 9)], "symbol int, quarter_end string, x int")
    events = spark.createDataFrame([(1, "2001-01-02", 1.5), (1, "2001-01-01", None), (3, "2001-02-01", 0.5)], "symbol int, event_date string, y double")
    guesses = spark.createDataFrame([(1, None, "a"), (1, "2001-03-31", "b")], "symbol int, observation_date string, z string")
    firms = spark.createDataFrame([(1, "one", "i"), (2, "two", "i"), (None, "none", "i")], "symbol int, company_name string, industry string")
    dated = [df.withColumn(d, F.to_date(d)) for df, d in ((filings, "quarter_end"), (events, "event_date"), (guesses, "observation_date"))]
    pages = plan.entity_history(firms, *dated)
    assert pages._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    rows = [(r.symbol, r.page and tuple(r.page), [(str(x[0]), *x[1:]) for x in r.filings], [(str(x[0]), *x[1:]) for x in r.events],
             [(str(x[0]), *x[1:]) for x in r.predictions]) for r in pages.collect()]
    assert sorted(rows, key=str) == sorted([
        (1, (2001, 1), [("2001-01-31", 7, 2)], [("2001-01-01", None, 1), ("2001-01-02", 1.5, 1)], []),
        (1, (2001, 3), [], [], [("2001-03-31", "b", 1)]), (1, (None, None), [("None", 8, 1)], [], [("None", "a", 1)]),
        (2, None, [], [], []), (None, None, [], [], [])], key=str)


def test_predictions_move_lines_once(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = src.predictions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved.count("Exchange hashpartitioning") == 2  # lines and orders


def test_dealt_rows_follow_the_size_of_their_files(spark, tmp_path):
    spark.range(600_000).select(F.xxhash64("id").alias("k"), "id").write.parquet(str(tmp_path / "big"))
    big = spark.read.parquet(str(tmp_path / "big"))
    parts = lambda df: int(re.search(r"RepartitionByExpression \[k#\d+L?\](?:, (\d+))?", df._jdf.queryExecution().optimizedPlan().toString())[1] or 0)
    assert parts(dealt(big.unionByName(big), "k", mb=1)) >= 8 and parts(dealt(big, "k", mb=1000)) == 0
    assert parts(dealt(spark.createDataFrame([(1,)], "k long"), "k")) == 0
    assert dealt(big.unionByName(big), "k", mb=1).count() == 1_200_000
