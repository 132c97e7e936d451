"""Registered queries beside DuckDB on the smallest tables. PITPANEL_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normal, sort_key

CORE = [
    "pipe_build_panel", "pipe_trajectory", "pipe_event_features", "join_asof_backward", "win_nth_session_after",
    "evaluate_all", "backtest_summary", "calibration_bins", "merge_update", "delete_cascade", "agg_median_delta",
    "fn_clip_quantiles", "arr_merge_indicators", "scan_chart_json", "pipe_parse_filings",
]
NAMES = [n for n in oracle_sql()] if os.environ.get("PITPANEL_ALL") else CORE


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[:3] == ["symbol", "observation_date", "quarter_end"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = queries()[name](spark, sf)
    order = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=sort_key)
    rel = con.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(normal(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=sort_key)
    assert sorted(names) == order
    assert got == want
