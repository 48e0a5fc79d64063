"""Pairs of near vectors against all pairs by numpy, with copies, clusters and edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marigold.operators import near_vectors


def by_hand(rows: dict[int, np.ndarray], threshold: float) -> set[tuple]:
    first = {}
    for i in sorted(rows):
        first.setdefault(tuple(rows[i]), i)
    ids = sorted(first.values())
    out = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = rows[a], rows[b]
            score = round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)), 6)
            if score >= threshold and np.any(x) and np.any(y):
                out.add((a, b, score))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.99, 1.0])
def test_pairs_equal_all_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK_VALUES", 256)  # blocks of 32 rows
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 8))
    x = [c + rnd.normal(size=8) * s for c in centres for s in (0.02, 0.1, 0.3) for _ in range(8)] + [centres[0]] * 60 + [2 * centres[0]] * 3 + [np.zeros(8)] * 2
    rows = dict(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()] + [(None, x[0].tolist()), (900, None), (901, [1.0]), (902, [float("inf")] * 8)], "vec_id long, embedding array<double>").repartition(4)
    held = near_vectors.classes(df)
    assert held.count() == len(rows)
    pairs = near_vectors.near_pairs(held, threshold)
    got = {(r.a, r.b, r.score) for r in pairs.collect()}
    assert got == by_hand(rows, threshold) and pairs.count() == len(got)
    linked = {r.id: (r["class"], r.n_links) for r in near_vectors.links(held, pairs).collect()}
    first = len(x) - 65
    assert all(linked[i][0] == first for i in range(first, first + 60)) and linked[len(x) - 1] == (len(x) - 2, 0)
    for i, (c, n) in linked.items():
        assert n == sum(c in (a, b) for a, b, _ in got), i


@pytest.mark.parametrize("ids", ["long", "string"])
def test_counts_equal_the_pairs_and_nothing_is_shuffled_by_pair(spark, monkeypatch, ids):
    monkeypatch.setattr(near_vectors, "BLOCK_VALUES", 256)
    monkeypatch.setattr(near_vectors, "STEP", 5)
    rnd = np.random.default_rng(8)
    x = [*rnd.normal(size=(200, 6)), *(np.eye(6)[i % 6] + rnd.normal(size=6) * 0.01 for i in range(120))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9, x[10].tolist()), (9, x[11].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").cast(ids).alias("vec_id"), "embedding").repartition(3)
    held = near_vectors.classes(df)
    for threshold in (0.3, 0.95):
        pairs = near_vectors.near_pairs(held, threshold)
        got, want = (sorted(map(tuple, d.collect())) for d in (near_vectors.near_counts(held, threshold), near_vectors.links(held, pairs)))
        assert got == want and sum(r[2] for r in got)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan  # vectors are not sent once for each block that they meet


def test_no_rows_and_bad_thresholds(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_vectors.near_pairs(near_vectors.classes(none), 0.5).collect() == []
    with pytest.raises(ValueError):
        near_vectors.near_pairs(near_vectors.classes(none), 0.0)


def test_a_vector_is_a_guest_only_near_its_cell():
    """Clusters far apart: no guests, so that cells meet by themselves."""
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    pivots = np.eye(6)
    x = np.repeat(pivots, 50, 0) + rnd.normal(size=(300, 6)) * 0.02
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(x.tolist())], ["id", "v"])
    narrow, wide = (sum(b.num_rows for b in near_vectors._cells(iter([batch]), pivots, reach)) for reach in (0.2, 1.5))
    assert narrow == 300 and wide == 1800
