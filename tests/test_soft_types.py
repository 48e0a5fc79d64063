"""Soft types against numpy."""

from __future__ import annotations

import numpy as np

from marigold.operators import soft_types


def test_rounds_against_numpy(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    begun = soft_types.start(v, concentration=12.0)
    fitted = soft_types.fit(v, begun, rounds=3)
    p = v.where("embedding IS NOT NULL").select("vec_id", "embedding").toPandas()
    x = np.stack(p.embedding.map(np.asarray)).astype(float)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, weight, levels = np.array(begun.means), np.array(begun.weights), []
    for _ in range(3):
        s = np.log(weight) + 12.0 * x @ mean.T
        top = s.max(1, keepdims=True)
        levels.append(float((top[:, 0] + np.log(np.exp(s - top).sum(1))).mean()))
        r = np.exp(s - top)
        r /= r.sum(1, keepdims=True)
        weight, mean = r.mean(0), r.T @ x
        mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    assert np.allclose(fitted.likelihoods, levels) and np.allclose(fitted.weights, weight) and np.allclose(fitted.means, mean)
    assert list(fitted.likelihoods) == sorted(fitted.likelihoods) and abs(sum(fitted.weights) - 1) < 1e-9


def test_types_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, label string"
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [1.0, 1.0], None), (4, None, "a"), (5, [0.0, 0.0], "b"), (6, [1.0], "c"), (7, [1.0, float("nan")], "d")]
    df = spark.createDataFrame(rows, kind)
    begun = soft_types.start(df, concentration=4.0)
    assert begun.labels == ["a", "b"]
    got = {r.vec_id: r for r in soft_types.typed(df, begun).collect()}
    assert got[1].type == "a" and got[2].type == "b" and got[3].type == "a"  # a tie goes to the first
    assert abs(got[3].entropy - np.log(2)) < 1e-9 and all(got[i].type is None and got[i].types is None for i in (4, 5, 6, 7))
    assert all(abs(sum(t.probability for t in got[i].types) - 1) < 1e-9 for i in (1, 2, 3))
    assert abs(got[1].types[0].probability - 1 / (1 + np.exp(-4))) < 1e-9
    warm = {r.vec_id: r for r in soft_types.typed(df, begun, temperature=4.0).collect()}
    assert abs(warm[1].types[0].probability - 1 / (1 + np.exp(-1))) < 1e-9
    assert soft_types.fit(df.limit(0), begun).means == begun.means
