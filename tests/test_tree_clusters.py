"""A tree of clusters against numpy, at more clusters than the driver would hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marigold.operators import ml, tree_clusters


def test_tree_of_clusters_against_numpy(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL")
    rows, table = tree_clusters.tree_kmeans(v, 60, rounds=2)
    got, centres = rows.toPandas(), table.toPandas().set_index("cluster")
    assert sorted(got.vec_id) == sorted(r.vec_id for r in v.select("vec_id").collect())
    assert len(centres) == 60 == got.cluster.nunique() and (got.cluster.value_counts().sort_index() == centres["size"].sort_index()).all()
    x = np.stack(got.embedding.map(np.asarray)).astype(float)
    c = np.stack(centres.centre.loc[got.cluster])
    assert np.allclose(((x - c) ** 2).sum(1), got.distance)
    assert got.distance.sum() < ((x - x.mean(0)) ** 2).sum()


def test_more_clusters_than_the_driver_holds(spark):
    n = ml.MAX_CENTRES + 500
    points = spark.range(2 * n).select(F.col("id").alias("vec_id"), F.array(F.pmod(F.col("id"), F.lit(n)).cast("double"), (F.pmod(F.col("id"), F.lit(n)) % 97).cast("double")).alias("embedding"))
    kept = ml.decimate(points, n)  # every vector twice, as many clusters as distinct vectors
    found = kept.select("vec_id", "embedding").toPandas()
    assert kept.columns == ["vec_id", "embedding"] and len(found) == n
    assert len(set(map(tuple, found.embedding))) == len(found) and found.vec_id.is_unique


def test_edges_of_the_tree(spark):
    kind = "vec_id long, embedding array<double>, other string"
    assert tree_clusters.tree_kmeans(spark.createDataFrame([], kind), 5)[0].count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], None) for i in range(50)] + [(98, None, "x"), (99, [1.0, float("nan")], "y"), (100, [1.0], "z")], kind)
    rows, table = tree_clusters.tree_kmeans(same, 40, rounds=1)
    assert sorted((r["size"], r["centre"]) for r in table.collect()) == [(2, [1.0, 0.0]), (50, [1.0, 2.0])]
    assert rows.where("vec_id = 98").count() == 0 and rows.count() == 52
    hot = spark.createDataFrame([(i, [float(i % 3 == 0) * i, 1.0], None) for i in range(300)], kind)  # two thirds of all rows are equal
    assert tree_clusters.tree_kmeans(hot, 40, rounds=1)[1].count() == 40
    with pytest.raises(ValueError):
        tree_clusters.tree_kmeans(hot.withColumn("cluster", F.lit(1)), 3)
