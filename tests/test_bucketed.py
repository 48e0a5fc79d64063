"""Bucketed tables: what an update touches, versions, conflicts and edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marigold.sources import bucketed


def files(table) -> set[str]:
    return set(table.read().inputFiles())


def rows(df) -> dict:
    got = df.collect()
    assert len({r.k for r in got}) == len(got)
    return {r.k: r.v for r in got}


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("bucket_like"))
    return bucketed.create(df.drop("bucket_like"), str(tmp_path / "t"), ["k"], 32)


def test_an_upsert_writes_only_the_buckets_it_changes(spark, table):
    before, held = rows(table.read()), files(table)
    batch = spark.createDataFrame([(5, "new five", 1), (5, "newer five", 2), (9, "v9", 1), (5000, "added", 1), (None, "no key", 1), (7, None, 1)], "k long, v string, n int")
    done = table.upsert(batch, "v", ["n"])
    assert (done["new"], done["updated"], done["same"]) == (1, 2, 1) and 1 <= done["touched"] <= 3
    assert rows(table.read()) == before | {5: "newer five", 5000: "added", 7: None}
    n = lambda paths: len({p.rsplit("/", 2)[1] for p in paths})
    assert n(held - files(table)) == done["touched"] and held & files(table) and n(held & files(table)) == 32 - done["touched"]
    assert rows(table.read(0)) == before and table.versions() == [0, 1]
    assert table.upsert(batch.where("k = 9"), "v") == {"new": 0, "updated": 0, "same": 1, "touched": 0} and table.versions() == [0, 1]
    assert table.upsert(batch.where("k = -1"), "v")["touched"] == 0
    assert rows(table.lookup(batch.select("k").where("k IN (5, 9)"))) == {5: "newer five", 9: "v9"}
    assert "bucket=" in "".join(table.lookup(batch.select("k").where("k = 5")).inputFiles()) and n(table.lookup(batch.select("k").where("k = 5")).inputFiles()) == 1


def test_deletes_appends_and_rebuckets(spark, table):
    keys = spark.createDataFrame([(3,), (4,), (4,), (99999,), (None,)], "k long")
    held = files(table)
    assert table.delete(keys) == 2 and set(rows(table.read())) == set(range(2000)) - {3, 4}
    assert held & files(table) and table.delete(keys) == 0
    batch = spark.createDataFrame([(3, "again"), (3, "again"), (10, "ignored")], "k long, v string")
    assert table.append_missing(batch) == 1 and rows(table.read())[3] == "again" and rows(table.read())[10] == "v10"
    assert table.append_missing(batch) == 0
    before = rows(table.read())
    table.rebucket(5)
    assert rows(table.read()) == before and table.manifest()["n_buckets"] == 5
    assert table.delete(spark.range(3000).select(F.col("id").alias("k"))) == len(before) and rows(table.read()) == {}
    assert table.upsert(batch.where("k = 10"), "v")["new"] == 1 and rows(table.read()) == {10: "ignored"}


def test_versions_conflicts_and_vacuum(spark, table):
    other = bucketed.BucketedTable(spark, table.path)
    content = table.manifest()
    table.upsert(spark.createDataFrame([(1, "x")], "k long, v string"), "v")
    with pytest.raises(bucketed.Conflict):
        other._publish(1, content)  # a writer that read version 0
    with pytest.raises(bucketed.Conflict):
        bucketed.create(table.read(), table.path, ["k"], 3)
    with pytest.raises(ValueError):
        bucketed.create(table.read(), f"{table.path}-many", ["k"], 1 << 20)
    before = rows(table.read())
    assert table.vacuum() == 1 and table.versions() == [1] and rows(table.read()) == before  # one bucket was rewritten


def test_keys_of_several_columns_and_empty_tables(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, "a"), (1, 3, "a"), (2, 1, "b")], "x long, y long, r string")
    table = bucketed.create(edges.where("x = 0"), str(tmp_path / "e"), ["x", "y", "r"], 8)
    assert table.read().collect() == [] and table.append_missing(edges.unionAll(edges)) == 3
    assert sorted(map(tuple, table.read().collect())) == [(1, 2, "a"), (1, 3, "a"), (2, 1, "b")]
