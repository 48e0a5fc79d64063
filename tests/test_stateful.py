"""State that outlives a run: the limiter's, the scan's, the ingested table's."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marigold import registry
from marigold.operators import profiles, scan_state, search
from marigold.streaming import limiter, messages


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(limiter._CONF, limiter.PROVIDER)
    yield
    spark.conf.unset(limiter._CONF)


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_the_limiter_gives_the_batch_result_for_late_and_equal_times(spark, tmp_path, rocksdb, limit):
    rnd = random.Random(limit)
    calls = [(u, i * 10 + u, float(rnd.randrange(0, 900))) for i in range(60) for u in (1, 2)] + [(3, 5000 + i, 100.0) for i in range(12)]
    batch = spark.createDataFrame(calls, "user_id long, call_id long, t double")
    source = str(tmp_path / "calls")
    late = sorted(calls, key=lambda c: c[2] + rnd.uniform(0, 200))  # up to 200 seconds out of order
    for a in range(0, len(late), 45):
        spark.createDataFrame(late[a : a + 45], batch.schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(9, -1, 50_000.0)], batch.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    limited = limiter.rate_limited_in_order(stream, limit, late="900 seconds")
    for _ in range(2):  # a second run finds nothing new
        limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("call_id >= 0").collect()))
    assert got == sorted(map(tuple, messages.rate_limited(batch, limit).collect())) and 0 < sum(r[3] for r in got) < len(got)


def test_the_limiter_asks_for_its_store(spark):
    with pytest.raises(RuntimeError):
        limiter.rate_limited_in_order(spark.createDataFrame([], "user_id long, call_id long, t double"), 1)


def test_interrupted_scans_equal_one(spark, tmp_path):
    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(420)] + [(None, 4), (4, None)], "from_pid long, to_pid long")
    seeds, levels = spark.createDataFrame([(1,), (2,), (2,), (None,)], "s long"), lambda s: {r.node: r.level for r in s.reached().collect()}
    one = scan_state.ScanState(spark, str(tmp_path / "one"), buckets=4)
    added = one.advance(edges, seeds)
    assert levels(one) == {r.node: r.level for r in profiles.frontier(edges, seeds, 100).collect()} and added == one.levels() == max(levels(one).values()) + 1
    two = str(tmp_path / "two")
    for steps in (1, 0, 2, 1, None):
        scan_state.ScanState(spark, two, buckets=4).advance(edges, seeds, steps=steps)
    again = scan_state.ScanState(spark, two, buckets=4)
    assert levels(again) == levels(one) and again.advance(edges, seeds) == 0
    more = edges.unionByName(spark.createDataFrame([(1000, 1001), (1001, 1)], edges.schema))
    assert again.advance(more, spark.createDataFrame([(1000,)], "s long")) == 2
    assert set(levels(again)) == set(levels(one)) | {1000, 1001} and levels(again)[1] == 0
    assert "PartitionFilters: [" in again.reached().where("level = 0 AND bucket IN (1)")._jdf.queryExecution().toString()


def test_skipped_nodes_are_reached_but_not_expanded(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 5)], "from_pid long, to_pid long")
    scan = scan_state.ScanState(spark, str(tmp_path / "s"), buckets=2)
    scan.skip(spark.createDataFrame([(2,), (None,)], "n long"))
    scan.advance(edges, spark.createDataFrame([(1,)], "s long"))
    assert {(r.node, r.level) for r in scan.reached().collect()} == {(1, 0), (2, 1), (4, 1), (5, 2)}
    none = scan_state.ScanState(spark, str(tmp_path / "n"))
    assert none.advance(edges) == 0 and none.advance(edges, spark.createDataFrame([], "s long")) == 0 and none.reached().collect() == []


def test_a_scan_ends_as_its_sql_where_parts_have_numbers_of_suppliers(spark, tmp_path):
    lines = [(1, 5, 1), (1, 6, 2), (1_000_005, 7, 3), (1_000_006, 8, 4), (1_000_006, 10, 5), (9, 7, 6), (1_000_007, 8, 7), (9, 8, 8)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i,) for i in range(12)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["frontier_resumed"]).fetchall()
    got = registry.queries()["frontier_resumed"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {n for n, level in want if level == 3}


def test_ingest_remembers_by_its_table(spark, tmp_path):
    kind, source, out = "channel_id long, message_id long, content string", str(tmp_path / "chat"), str(tmp_path / "out")
    for rows in ([(1, 1, "a"), (1, 1, "a"), (2, 1, " ")], [(1, 1, "again"), (1, 2, "b")], [(1, 2, "b"), (3, 1, None), (3, 2, "c")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        messages.ingest(spark.readStream.schema(kind).parquet(source), out, str(tmp_path / "state")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 1, "a"), (1, 2, "b"), (3, 2, "c")]
    messages.ingest(spark.readStream.schema(kind).parquet(source), out, str(tmp_path / "lost")).awaitTermination(120)  # a new checkpoint reads all again
    assert spark.read.parquet(out).count() == 3


def test_searches_in_blocks_give_the_same(spark, sf, monkeypatch):
    v, docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("embeddings", "documents", "benchmark"))
    asked = v.where("vec_id % 20 = 0")
    near, overlap = (sorted(map(tuple, x.collect())) for x in (search.similar(v, asked, 5), search.word_overlap(docs, items, 3)))
    monkeypatch.setattr(search, "MAX_QUERIES", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 60)
    found = search.similar(v, asked, 5)
    assert sorted(map(tuple, found.collect())) == near
    sizes = v.select(F.pmod(F.xxhash64("vec_id"), F.lit(9)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert sizes < v.count() / 4 and "_r" in found._jdf.queryExecution().toString()  # no key holds the whole table
    monkeypatch.setattr(search, "MAX_QUERIES", 10_000)
    monkeypatch.setattr(search, "MATRIX", 400)
    assert sorted(map(tuple, search.word_overlap(docs, items, 3).collect())) == overlap
