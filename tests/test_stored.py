"""Partition-wise changes leave other files alone; versions change at one rename and readers pin them."""

import os

import pytest
from pitpanel.operators import merge
from pitpanel.operators.stored import PartitionedTable, VersionedTable
from pitpanel.session import scratch_path
from pitpanel.sources import adapters as src
from pitpanel.operators import trajectory
from pyspark.sql import functions as F


def files(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.relpath(folder, path), set()).add((n, os.stat(os.path.join(folder, n)).st_mtime_ns))
    return out


@pytest.fixture
def table(spark):
    t = PartitionedTable(scratch_path(spark, "parts"), {"bucket": "pmod(k, 5)"})
    t.create(spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("old").alias("s")))
    return t


def test_a_delete_in_one_partition_leaves_all_other_files(spark, table):
    before = files(table.path)
    table.delete(spark, spark.createDataFrame([(3,)], "k long"), lambda part: part.where("k > 50"))
    after = files(table.path)
    assert set(before) == set(after) and len(before) == 5
    assert {f for f in before if before[f] != after[f]} == {"bucket=3"}
    assert sorted(r.k for r in table.read(spark).collect()) == [k for k in range(100) if k % 5 != 3 or k > 50]


def test_a_partition_left_without_rows_goes(spark, table):
    table.delete(spark, spark.createDataFrame([(4,), (1,)], "k long"), lambda part: part.where("k % 5 = 1"))
    assert set(files(table.path)) == {f"bucket={b}" for b in (0, 1, 2, 3)}
    assert table.read(spark).count() == 80


def test_upserts_meet_the_whole_table_merge(spark, table):
    payload = spark.createDataFrame([(7, None), (12, "new"), (202, "added")], "k long, s string")
    want = {tuple(r) for r in merge.merge_update(table.rows(spark), payload, ["k"]).collect()}
    before = files(table.path)
    table.upsert(spark, payload, ["k"])
    assert {tuple(r) for r in table.rows(spark).collect()} == want and len(want) == 101
    assert {f for f, x in files(table.path).items() if x != before[f]} == {"bucket=2"}
    table.upsert(spark, payload, ["k"])  # the same again changes nothing
    assert {tuple(r) for r in table.rows(spark).collect()} == want
    with pytest.raises(Exception, match="repeated payload key"):
        table.upsert(spark, payload.unionByName(payload), ["k"])
    assert {tuple(r) for r in table.rows(spark).collect()} == want


def test_insert_replace_and_nulls(spark):
    t = PartitionedTable(scratch_path(spark, "parts"), {"day": "d"})
    t.create(spark.sql("SELECT * FROM VALUES (DATE '2001-01-01', 'a', 1), (NULL, 'a', 2), (DATE '2001-01-02', 'b', 3) t(d, s, v)"))
    t.insert_new(spark, spark.sql("SELECT CAST(NULL AS DATE) AS d, 'a' AS s, 9 AS v UNION ALL SELECT NULL, 'c', 9"), ["d", "s"])
    assert sorted((str(r.d), r.s, r.v) for r in t.rows(spark).collect()) == [("2001-01-01", "a", 1), ("2001-01-02", "b", 3), ("None", "a", 2), ("None", "c", 9)]
    before = files(t.path)
    t.replace(spark, spark.sql("SELECT DATE '2001-01-02' AS d, 'z' AS s, 7 AS v"), "d")
    assert sorted((str(r.d), r.s) for r in t.rows(spark).collect()) == [("2001-01-01", "a"), ("2001-01-02", "z"), ("None", "a"), ("None", "c")]
    assert {f for f, x in files(t.path).items() if x != before[f]} == {"day=2001-01-02"}
    t.upsert(spark, t.rows(spark).limit(0), ["d"])
    assert t.read(spark).count() == 4


def test_a_row_that_moves_to_another_partition_fails_and_changes_nothing(spark, table):
    before = files(table.path)
    with pytest.raises(Exception, match="outside the touched partitions"):
        table.rewrite(spark, table.touched(spark.createDataFrame([(0,)], "k long")), lambda part: part.withColumn("k", F.col("k") + 1))
    assert files(table.path) == before


def test_versions_change_at_the_pointer(spark, monkeypatch):
    t = VersionedTable(scratch_path(spark, "versions"))
    assert t.current(spark) is None and t.read(spark, spark.range(1).schema).collect() == []
    with pytest.raises(FileNotFoundError):
        t.read(spark)
    first = t.write(spark.range(3))
    pinned = t.read(spark)
    staged = t.stage(t.read(spark).selectExpr("id + 10 AS id"))  # reads the version it follows
    assert {r.id for r in t.read(spark).collect()} == {0, 1, 2}  # written, not yet current
    monkeypatch.setattr(VersionedTable, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        t.write(spark.range(99))
    monkeypatch.undo()
    assert t.current(spark) == first and {r.id for r in t.read(spark).collect()} == {0, 1, 2}
    t.publish(spark, staged)
    assert {r.id for r in t.read(spark).collect()} == {10, 11, 12}
    assert {r.id for r in pinned.collect()} == {0, 1, 2} == {r.id for r in t.read(spark, version=first).collect()}
    t.write(spark.range(1))
    assert t.expire(spark, 2) == [first.rsplit("/", 1)[1]]
    assert {r.id for r in t.read(spark).collect()} == {0}
    assert not [n for n in os.listdir(t.path) if n.startswith("_current-")]


def test_a_failed_job_stages_nothing_that_is_read(spark):
    t = VersionedTable(scratch_path(spark, "versions"))
    t.write(spark.range(3))
    with pytest.raises(Exception, match="broken"):
        t.write(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")))
    assert t.read(spark).count() == 3


def test_tied_filings_have_one_answer(spark, sf):
    """The same filings in any partitioning give the same state: (order, line) repeats with other values."""
    filings = src.filings(spark, sf)
    assert filings.groupBy("symbol", "quarter_end", *src.FILING_ORDER[:2]).count().where("count > 1").count() > 0
    seen = set()
    for k in range(5):
        mixed = filings.repartition(k + 2, F.xxhash64("pledge_pct_equity", F.lit(k))).sortWithinPartitions(F.xxhash64("promoter_holding_pct", F.lit(k)))
        rows = trajectory.latest_known_filing(mixed, 30, src.FILING_ORDER).collect()
        seen.add(tuple(sorted(str(r) for r in rows)))
    assert len(seen) == 1
