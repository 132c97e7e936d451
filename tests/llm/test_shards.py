"""Virtual slots: balance, moves, places, and rows that are odd."""

from pyspark.sql import functions as F

from pitpanel.llm import shards
from pitpanel.llm.registered import QUERIES


def _records(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    return docs.select("doc_id", shards.record_size(F.col("text")).alias("size"), shards.slot_of(F.col("doc_id"), F.col("text"), 64).alias("slot"),
                       F.pmod(F.monotonically_increasing_id(), F.lit(shards.PARTS)).cast("int").alias("part"))


def test_query_is_balanced_and_gapless(spark, sf):
    rows = QUERIES["op3_sharding"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").alias("n"), F.crc32("text").alias("c")).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d.doc_id, d.n + 16, d.c) for d in docs} and len(rows) == len(docs)
    load, places = {}, {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert set(load) <= set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    mean, largest = sum(load.values()) / 40, max(d.n for d in docs) + 16
    assert max(load.values()) <= mean + largest


def test_slots_do_not_depend_on_the_table(spark):
    a = {(r.doc_id, r.slot) for r in _records(spark, [(i, "x" * i, "") for i in range(50)]).collect()}
    b = {(r.doc_id, r.slot) for r in _records(spark, [(i, "x" * i, "") for i in range(20)]).collect()}
    assert b < a


def test_balancing_moves_few_slots_and_evens_the_load(spark):
    first = shards.first_map(spark, 4, 64)
    load = spark.createDataFrame([(i, 1000 if i % 4 == 0 else 10) for i in range(64)], "slot int, bytes long")
    second = shards.rebalance(first, load, 4)
    joined = second.join(load, "slot").join(first.withColumnRenamed("shard", "old").drop("version"), "slot").collect()
    assert len(joined) == 64 and {r.version for r in joined} == {1}
    by = {}
    for r in joined:
        by[r.shard] = by.get(r.shard, 0) + r["bytes"]
    assert max(by.values()) - min(by.values()) <= 1000
    assert sum(r.shard != r.old for r in joined) <= 16
    grown = shards.rebalance(second, load, 5).collect()
    assert {r.version for r in grown} == {2} and {r.shard for r in grown} == set(range(5))


def test_odd_rows(spark):
    rows = [(None, None, "a"), (None, None, "a"), (None, "x", "a"), (1, None, "b"), (1, "", "b"), (2, "é" * 100_000, "c"), (2, "same", "d"), (2, "same", "d")]
    records = _records(spark, rows)
    table = shards.rebalance(shards.first_map(spark, 3, 64), records.groupBy("slot").agg(F.sum("size").alias("bytes")), 3)
    out = shards.positions(shards.assign(records, table), ["doc_id", "size"]).collect()
    assert len(out) == len(rows)
    for s in range(3):
        assert sorted(r.position for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert max(r["size"] for r in out) == 200_016


def test_no_rows(spark):
    records = _records(spark, [])
    table = shards.rebalance(shards.first_map(spark, 3, 64), records.groupBy("slot").agg(F.sum("size").alias("bytes")), 3)
    assert table.count() == 64
    assert shards.positions(shards.assign(records, table), ["doc_id"]).collect() == []
