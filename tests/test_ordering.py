"""Order statistics: the split path must equal a plain sort, hot ties included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import metrics
from pitpanel.operators.ordering import positions, quantiles, running, spread, top_k


@pytest.fixture(scope="module")
def rows(spark):
    # One date holds most rows, and a third of them share one score.
    rng = np.random.default_rng(7)
    n = 3000
    score = np.where(rng.random(n) < 0.34, 0.5, rng.random(n))
    frame = pd.DataFrame({"day": np.where(rng.random(n) < 0.9, "hot", "cold"), "symbol": np.arange(n),
                          "probability": score, "label": (rng.random(n) < 0.3).astype(int)})
    return frame, spark.createDataFrame(frame).repartition(6)


@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_positions_equal_a_sort(rows, buckets):
    frame, df = rows
    got = positions(df, ["day"], ["probability", "symbol"], buckets=buckets).toPandas().set_index("symbol")["position"]
    want = frame.sort_values(["probability", "symbol"]).groupby("day").cumcount() + 1
    want.index = frame.sort_values(["probability", "symbol"])["symbol"]
    assert (got.sort_index() == want.sort_index()).all()


def test_null_groups_are_kept_everywhere(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 0), ("a", 2, 0.9, 1), (None, 3, 0.2, 0), (None, 4, 0.8, 1)], "day string, symbol int, probability double, label int")
    assert sorted((r.symbol, r.position) for r in positions(df, ["day"], ["probability"]).collect()) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    assert sorted(str(r.day) for r in quantiles(df, ["day"], "probability", {"mid": 0.5}).collect()) == ["None", "a"]
    assert sum(r.n for r in metrics.calibration_bins(df, ["day"], 2).collect()) == 4
    assert metrics.rank_groups(df, ["day"], "probability", 2).count() == 4
    assert {r.day for r in metrics.evaluate_all(df.withColumn("observation_date", F.lit("x")), ["day"], min_rows=1).collect()} >= {"a", None}


def test_buckets_split_hot_groups_and_hot_ties(rows):
    _, df = rows
    sizes = spread(df, ["day"], ["probability", "symbol"], 64).groupBy("day", "__bucket").count().toPandas()
    assert sizes["count"].max() < 3000 / 6


def test_running_totals(rows):
    frame, df = rows
    got = running(df, [], ["symbol"], {"s": F.col("label")}).toPandas().sort_values("symbol")
    assert (got["s"].to_numpy() == frame["label"].cumsum().to_numpy()).all()
    assert set(got["s_total"]) == {int(frame["label"].sum())}


def test_quantiles_equal_numpy(rows):
    frame, df = rows
    got = quantiles(df, ["day"], "probability", {"a": 0.01, "b": 0.5, "c": 0.937}).toPandas().set_index("day")
    for day, block in frame.groupby("day"):
        assert np.allclose(got.loc[day, ["a", "b", "c"]].astype(float), np.quantile(block["probability"], [0.01, 0.5, 0.937]))


def test_auc_equals_pair_counting(rows):
    frame, df = rows
    got = metrics.within_date_auc(df, [], "day").toPandas().set_index("day")["auc"]
    for day, b in frame.groupby("day"):
        pos, neg = b[b.label == 1].probability.to_numpy(), b[b.label == 0].probability.to_numpy()
        diff = pos[:, None] - neg[None, :]
        assert got[day] == pytest.approx((diff > 0).mean() + 0.5 * (diff == 0).mean(), abs=1e-12)


def test_bands_are_equal_counts_not_ntile(spark):
    df = spark.createDataFrame([(f"s{i}", "d", float(i)) for i in range(7)], "symbol string, day string, p double")
    got = [r.band for r in metrics.rank_groups(df, ["day"], "p", 5).orderBy("p").collect()]
    assert got == [int(np.ceil((i + 1) / 7 * 5)) for i in range(7)]


def test_skips_are_reported_not_scored(spark):
    df = spark.createDataFrame([("thin", 0.1, 1), ("thin", 0.2, 0)] + [("one", i / 20, 0) for i in range(12)],
                               "day string, probability double, label int")
    got = {r.day: r for r in metrics.within_date_auc(df, [], "day").collect()}
    assert got["thin"].reason == "too few rows" and got["one"].reason == "single class"
    assert got["thin"].auc is None and got["one"].auc is None


def test_top_k_ties_go_by_symbol(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "symbol string, p double").withColumn("g", F.lit(1))
    got = [r.symbol for r in top_k(df, ["g"], [F.desc("p"), F.col("symbol")], 2).orderBy("position").collect()]
    assert got == ["c", "a"]


def test_many_groups_join_by_shuffle(rows, monkeypatch):
    from pitpanel.operators import ordering

    frame, df = rows
    monkeypatch.setattr(ordering, "FEW_GROUPS", 1)
    got = positions(df, ["day"], ["probability", "symbol"]).toPandas().set_index("symbol")["position"]
    ordered = frame.sort_values(["probability", "symbol"])
    want = ordered.groupby("day").cumcount() + 1
    want.index = ordered["symbol"]
    assert (got.sort_index() == want.sort_index()).all()
