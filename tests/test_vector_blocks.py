"""Searches by blocks of vectors against the search row by row, on odd vectors, ties and copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marigold.operators import search, vector_blocks


@pytest.mark.parametrize("ids, kind", [("long", "float"), ("string", "double")])
def test_blocks_give_what_rows_give(spark, monkeypatch, ids, kind):
    monkeypatch.setattr(search, "ROW_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    rnd = np.random.default_rng(5)
    x = [*rnd.normal(size=(150, 8)), *[np.ones(8)] * 30, *(rnd.normal(size=(20, 8)) * 1e-5), np.zeros(8), *np.round(rnd.normal(size=(60, 8)))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[9].tolist()), (7, x[8].tolist()), (500, None), (None, [1.0] * 8), (501, [1.0, 2.0]), (502, [float("nan")] * 8), (503, [1.0] * 7 + [None]), (504, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").cast(ids).alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).repartition(3)
    asked = df.where("CAST(vec_id AS LONG) % 5 = 0 OR CAST(vec_id AS LONG) IN (7, 502, 503)")
    held, q = (d.where("embedding IS NOT NULL") for d in (df, asked))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for k in (1, 6, 400):
        want = search._scored(held, q, "vec_id", "embedding", 6).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        got = search.similar(df, asked, k)
        same = [sorted(map(repr, map(tuple, d.select("query_id", "rank", "vec_id", "score").collect()))) for d in (got, want)]
        assert same[0] == same[1] and len(same[0]) >= 40 * min(k, 6)


def test_vectors_meet_in_blocks_and_not_row_by_row(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = search.similar(v, v.where("vec_id % 20 = 0"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "NestedLoop" not in plan and "zip_with" not in plan


def test_labels_are_inferred_from_blocks(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert "NestedLoop" not in search.infer_label(v, v.where("vec_id % 20 = 0"), 12)._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_the_one_of_sql(spark):
    x = np.array([0.1234565, -0.1234565, 2.5e-6, 0.3000005, -0.0000001, 1.0, 0.9999995, 0.0])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert vector_blocks.rounded(x, 6).tolist() == want
