"""Literal cases for trajectory, bars, events and as-of joins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import scalars as fx
from pitpanel.operators import asof, bars, events, trajectory
from pitpanel.settings import Windows

D = dt.date
QUARTERS = [D(2023, 3, 31), D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 31), D(2024, 3, 31), D(2024, 6, 30)]


def quarter_array():
    return fx.quarter_ends(F.lit(QUARTERS[0]), F.lit(QUARTERS[-1]))


def state(spark, values, statuses=None):
    rows = []
    for i, v in enumerate(values):
        if v == "gap":
            continue
        status = statuses[i] if statuses else "PLEDGE_PRESENT"
        rows.append(("A", QUARTERS[i], QUARTERS[i] + dt.timedelta(days=10), 60.0, v, v, status))
    return spark.createDataFrame(rows, "symbol string, quarter_end date, submission_date date, promoter_holding_pct double, "
                                       "pledge_pct_promoter double, pledge_pct_equity double, pledge_status string")


def built(spark, values, column, statuses=None):
    out = trajectory.trajectory_features(state(spark, values, statuses), quarter_array()).orderBy("quarter_end").collect()
    return [r[column] for r in out]


def test_streak(spark):
    assert built(spark, [10.0, 12.0, 14.0, 18.0, 11.0, 13.0], "consecutive_rising_q") == [None, 1, 2, 3, 0, 1]


def test_flat_quarter_ends_the_streak(spark):
    assert built(spark, [10.0, 12.0, 12.0, 13.0, 14.0, 15.0], "consecutive_rising_q") == [None, 1, 0, 1, 2, 3]


def test_gap_is_not_a_change(spark):
    values = [10.0, "gap", "gap", 40.0, 40.0, 40.0]
    assert built(spark, values, "pledge_chg_1q")[:4] == [None, 0.0, None, None]
    assert built(spark, values, "is_stale")[:4] == [0, 1, 0, 0]


def test_acceleration(spark):
    assert built(spark, [10.0, 15.0, 25.0, 25.0, 25.0, 25.0], "pledge_accel")[:4] == [None, None, 5.0, -10.0]


def test_rolling_max_forgets(spark):
    assert built(spark, [90.0, 1.0, 1.0, 1.0, 1.0, 1.0], "pledge_max_4q") == [90.0, 90.0, 90.0, 90.0, 1.0, 1.0]


def test_unavailable_is_never_a_fall(spark):
    values, statuses = [40.0, 0.0, 40.0, 40.0, 40.0, 40.0], ["PLEDGE_PRESENT", "UNAVAILABLE"] + ["PLEDGE_PRESENT"] * 4
    assert built(spark, values, "pledge_chg_1q", statuses)[1] == 0.0
    assert built(spark, values, "is_stale", statuses)[1] == 0


def test_revisions_known_by_the_cutoff(spark):
    q = QUARTERS[0]
    rows = [(1, "A", q, q + dt.timedelta(days=5)), (2, "A", q, q + dt.timedelta(days=20)), (3, "A", q, q + dt.timedelta(days=60)),
            (4, "B", q, q + dt.timedelta(days=50)), (5, "B", q, q + dt.timedelta(days=70))]
    df = spark.createDataFrame(rows, "filing_id bigint, symbol string, quarter_end date, submission_date date")
    got = {r.symbol: r.filing_id for r in trajectory.latest_known_filing(df).collect()}
    assert got == {"A": 2, "B": 4}


def prices(spark, closes, start=D(2023, 1, 2), symbol="A"):
    days = pd.bdate_range(start, periods=len(closes)).date
    return spark.createDataFrame([(symbol, d, float(c), 100.0) for d, c in zip(days, closes)],
                                 "symbol string, trade_date date, adj_close double, volume double"), list(days)


def drawdowns(spark, closes, h):
    df, _ = prices(spark, closes)
    return [r.v for r in df.select("trade_date", bars.forward_drawdown(h).alias("v")).orderBy("trade_date").collect()]


def test_forward_drawdown(spark):
    got = drawdowns(spark, [100, 95, 80, 90, 110], 3)
    assert got[0] == pytest.approx(-0.20) and got[1] == pytest.approx(80 / 95 - 1) and got[2:] == [None, None, None]


def test_drawdown_is_from_entry_not_peak(spark):
    assert drawdowns(spark, [100, 120, 140, 119, 125], 4)[0] == pytest.approx(0.19)


W = Windows(volatility_bars=20, drawdown_bars=10, return_bars=20, turnover_bars=20, horizon_bars=3)


def label(spark, closes, at, w=W, **kw):
    df, days = prices(spark, closes)
    obs = spark.createDataFrame([("A", days[at])], "symbol string, observation_date date")
    bench = df.select("trade_date", "adj_close")
    return bars.market_and_label(obs, df, bench, w, **kw).first()


@pytest.mark.parametrize("trough,want", [(85.0, 1), (84.99, 1), (85.01, 0)])
def test_threshold_is_inclusive(spark, trough, want):
    assert label(spark, [100, trough, 100, 100, 100], 0).label == want


def test_embargo_leaves_no_label(spark):
    row = label(spark, [100, 100, 100, 100], 2)
    assert row.label is None and row.label_is_valid == 0


def test_lowest_price_on_the_entry_bar_is_not_in_the_window(spark):
    row = label(spark, [100, 50, 100, 100, 100], 1)
    assert row.fwd_max_drawdown == pytest.approx(1.0) and row.label == 0


def test_date_before_all_bars_and_holiday_entry(spark):
    df, days = prices(spark, [100, 90, 80, 70, 60, 50])
    obs = spark.createDataFrame([("A", days[0] - dt.timedelta(days=9)), ("A", days[4] + dt.timedelta(days=1)), ("B", days[2])],
                                "symbol string, observation_date date")
    got = {(r.symbol, r.observation_date): r for r in bars.market_and_label(obs, df, df.select("trade_date", "adj_close"), W).collect()}
    assert len(got) == 3
    assert got[("A", days[0] - dt.timedelta(days=9))].entry_price is None
    assert got[("A", days[4] + dt.timedelta(days=1))].entry_price == 60.0
    assert got[("B", days[2])].label_is_valid == 0


def test_one_pass_equals_per_bar_frames(spark):
    rng = __import__("numpy").random.default_rng(3)
    df, days = prices(spark, 100 * (1 + rng.normal(0, 0.02, 80)).cumprod())
    obs = spark.createDataFrame([("A", d) for d in days[::7]], "symbol string, observation_date date")
    got = bars.market_and_label(obs, df, df.select("trade_date", "adj_close"), W).toPandas().sort_values("observation_date")
    base = df.withColumn("log_return", bars.log_return())
    want = base.select("trade_date", bars.rolling_std("log_return", 20).alias("v"), bars.rolling_max("adj_close", 10, 2).alias("m"),
                       bars.forward_drawdown(3).alias("d"), bars.lagged_return(20).alias("r")).toPandas().set_index("trade_date")
    want = want.loc[list(got.observation_date)]
    assert want.v.to_numpy() == pytest.approx(got.volatility_90d.to_numpy(), nan_ok=True)
    assert want.d.to_numpy() == pytest.approx(got.fwd_max_drawdown.to_numpy(), nan_ok=True)
    assert want.r.to_numpy() == pytest.approx(got.return_90d.to_numpy(), nan_ok=True)


def test_break_blanks_features_after_it_only_and_voids_labels_before_it(spark):
    closes = [100.0] * 60 + [50.0] * 60
    before = label(spark, closes, 50, blank_breaks=True)
    after = label(spark, closes, 75, blank_breaks=True)
    assert before.volatility_90d is not None and after.volatility_90d is None
    assert after.trailing_dd_60d is not None  # 15 bars on, outside the shorter window
    assert label(spark, closes, 58, void_breaks=True).label is None
    assert label(spark, closes, 56, void_breaks=True).label == 0
    assert label(spark, closes, 60, void_breaks=True).label == 0


def event_rows(spark, rows):
    return spark.createDataFrame(rows, "symbol string, event_date date, event_type string, pct_equity double")


def block(spark, rows, on, **kw):
    obs = spark.createDataFrame([("A", on)], "symbol string, observation_date date")
    return events.event_features(obs, event_rows(spark, rows), **kw).first()


def test_disclosure_buffer_boundary(spark):
    rows = [("A", D(2023, 3, 27), "creation", 1.0)]
    assert block(spark, rows, D(2023, 4, 9)).event_count_90d == 0
    assert block(spark, rows, D(2023, 4, 10)).event_count_90d == 1


def test_event_windows(spark):
    on = D(2024, 1, 1)
    end = on - dt.timedelta(days=14)
    rows = [("A", end, "creation", 2.0), ("A", end - dt.timedelta(days=90), "release", 0.5),
            ("A", end - dt.timedelta(days=91), "creation", 9.0), ("A", end - dt.timedelta(days=365), "invocation", 1.0),
            ("A", end - dt.timedelta(days=366), "invocation", 1.0), ("A", on, "creation", 7.0)]
    got = block(spark, rows, on)
    assert (got.event_created_90d, got.event_released_90d, got.event_net_90d, got.event_count_90d) == (2.0, 0.5, 1.5, 2.0)
    assert got.event_invocations_365d == 1 and got.event_days_since == 0


def test_no_event_is_zero_but_days_since_is_unknown(spark):
    got = block(spark, [("B", D(2023, 1, 1), "creation", 1.0)], D(2024, 1, 1))
    assert got.event_count_90d == 0 and got.event_days_since is None


def test_days_since_reaches_beyond_every_window(spark):
    got = block(spark, [("A", D(2020, 1, 1), "creation", 1.0)], D(2024, 1, 15))
    assert got.event_days_since == (D(2024, 1, 1) - D(2020, 1, 1)).days and got.event_count_90d == 0


def test_unknown_percentage_is_kept_at_zero_and_summed_as_nothing(spark):
    rows = event_rows(spark, [("A", D(2023, 1, 1), "creation", None), ("A", D(2023, 1, 2), "creation", 2.0)])
    assert events.filter_material(rows, 0.0).count() == 2 and events.filter_material(rows, 0.01).count() == 1
    obs = spark.createDataFrame([("A", D(2023, 2, 1))], "symbol string, observation_date date")
    assert events.event_features(obs, rows).first().event_created_90d == 2.0


def test_asof_by_time_equals_plain(spark):
    left = spark.sql("SELECT id AS k, 'hot' AS key, date_add(DATE '2000-01-01', CAST(id * 37 % 150 * 30 AS INT)) AS d FROM range(400)")
    right = spark.sql("SELECT 'hot' AS key, date_add(DATE '2001-06-01', CAST(id * 61 AS INT)) AS t, id AS v FROM range(40)")
    plain = asof.asof_backward(left, right, ["key"], "d", "t", ["v", "t"])
    split = asof.asof_backward(left, right, ["key"], "d", "t", ["v", "t"], by_time=True)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    assert plain.where("v IS NULL").count() > 0


def test_observation_dates_roll_forward_or_vanish(spark):
    bench = spark.createDataFrame([(D(2023, 5, 2),), (D(2023, 7, 30),)], "trade_date date")
    q = spark.createDataFrame([(D(2023, 3, 31),), (D(2023, 6, 30),), (D(2023, 9, 30),)], "quarter_end date")
    got = [r.observation_date for r in asof.observation_dates(q, bench).orderBy("quarter_end").collect()]
    assert got == [D(2023, 5, 2), D(2023, 7, 30), None]


def test_dates_meet_slices_and_not_every_bar_of_their_window(spark):
    df, days = prices(spark, [100, 101, 99, 103, 98, 97, 105, 104])
    df = df.unionByName(spark.createDataFrame([("A", None, 1.0, 100.0)], df.schema))  # a bar without a day is in no window
    obs = spark.createDataFrame([("A", days[4]), ("A", days[4]), ("A", days[1]), ("Z", days[4]), (None, days[4])],
                                "symbol string, observation_date date")
    w = Windows(volatility_bars=4, drawdown_bars=4, return_bars=2, turnover_bars=4, horizon_bars=3)
    found = bars.market_and_label(obs, df, df.where("trade_date IS NOT NULL").select("trade_date", "adj_close"), w)
    got = {(r.symbol, r.observation_date): r for r in found.collect()}
    assert len(got) == 4 and got[("Z", days[4])].pos is None and got[(None, days[4])].label_is_valid == 0
    row, first = got[("A", days[4])], got[("A", days[1])]
    closes = np.array([101.0, 99, 103, 98])
    moves = np.diff(np.log([100.0, 101, 99, 103, 98]))
    assert row.pos == 5 and first.pos == 2 and first.log_turnover_90d == pytest.approx(np.log(10050.0))
    assert row.volatility_90d == pytest.approx(moves.std(ddof=1) * 252 ** 0.5)
    assert row.trailing_dd_60d == pytest.approx(98 / 103 - 1)
    assert row.log_turnover_90d == pytest.approx(np.log(np.median(closes * 100)))
    assert row.fwd_max_drawdown == pytest.approx(97 / 98 - 1) and row.label_is_valid == 1
    # The median was an aggregate over rows of date times bar, which were sorted and spilled.
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()


def test_entry_bars_equal_those_of_per_bar_windows_but_travel_narrow(spark):
    rng = np.random.default_rng(8)
    rows = [(s, D(2023, 1, 2) + dt.timedelta(days=int(d)), float(c), 100.0)
            for s in "AB" for d, c in zip(range(0, 120, 2), rng.choice([0.0, 40.0, 100.0, 101.0], 60, p=[0.05, 0.2, 0.35, 0.4]))]
    rows += [("A", D(2023, 6, 1), None, 100.0), ("A", D(2023, 6, 2), 99.0, None), ("B", None, 70.0, 100.0), (None, D(2023, 1, 2), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, adj_close double, volume double")
    obs = spark.createDataFrame([(s, D(2023, 1, 1) + dt.timedelta(days=d)) for s in "ABC" for d in range(0, 160, 9)], "symbol string, observation_date date")
    bench = df.where("trade_date IS NOT NULL AND symbol = 'A'").select("trade_date", "adj_close")
    found = bars.market_and_label(obs, df, bench, W)
    per_bar = bars.numbered_bars(df, return_bars=W.return_bars, floor=W.break_floor).where("trade_date IS NOT NULL")
    want = bars.anchor(obs, per_bar).select("symbol", "observation_date", "pos", F.col("adj_close").alias("entry_price"), "last_break", "next_break",
                                            F.when(F.col("n_bars") >= 2, F.col("lagged_return")).alias("return_90d"))
    got = found.select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("last_break IS NOT NULL AND next_break IS NOT NULL").count() > 0
    # Numbering, returns and breaks were columns beside each bar, sorted up and down and gathered, which spilled.
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
