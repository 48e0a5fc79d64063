"""The inverted file: recall against the exact answer, edges, skew, additions and pruning."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marigold.operators import ann, search


def built(spark, df, path, **options) -> ann.Index:
    return ann.add(ann.create(spark, str(path), ann.fit(df, **options)), df)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_against_the_exact_answer(spark, sf, size, tmp_path):
    v = spark.read.parquet(sf.replace("sf0.001", size) + "/embeddings.parquet")
    index, asked = built(spark, v, tmp_path / "i"), v.where("vec_id % 20 = 0")
    assert index.codes().count() and index.rows().count() == v.count()
    r = ann.recall(ann.search(index, asked, 10), search.similar(v, asked, 10)).first()
    assert r.queries == asked.count() and r.recall >= 0.9
    few = ann.recall(ann.search(index, asked, 10, probes=2), search.similar(v, asked, 10)).first().recall
    assert 0 < few < r.recall  # probes decide


def test_all_lists_and_all_candidates_are_exact(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    index, asked = built(spark, v, tmp_path / "i", lists=7), v.where("vec_id % 50 = 0")
    got = ann.search(index, asked, 5, probes=7, refine=v.count()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, search.similar(v, asked, 5).collect()))


def test_a_task_passes_on_a_query_s_best_codes_alone(spark, sf, tmp_path, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    index, asked = built(spark, v, tmp_path / "i", lists=40), v.where("vec_id % 20 = 0")
    seen, held = [], ann.written
    monkeypatch.setattr(ann, "written", lambda df, name="table", **o: seen.append(df) or held(df, name, **o))
    ann.search(index, asked, 2, probes=40, refine=5)
    candidates = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in candidates
    rows = held(index.codes().select("list", "part", "ats", "codes").coalesce(2), "c")
    x = np.array([r.embedding for r in asked.collect()], np.float32)
    best = ann._Best(None, x, index.model, 40, 5)
    for r in rows.collect():
        codes = np.frombuffer(r.codes, np.uint8)
        best.scan(r.list, r.part, np.frombuffer(r.ats, "<i8"), codes.reshape(len(r.ats) // 8, -1))
    assert len(best.trim()[0]) == 5 * len(x)


def test_edges_and_a_hot_list(spark, tmp_path):
    rnd = random.Random(4)
    same = [0.5, 0.5, 0.5, 0.5]
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(i, same) for i in range(200, 300)]  # a third is one vector
    odd = [(300, None), (301, [1.0, 2.0]), (302, [float("nan"), 1.0, 1.0, 1.0]), (303, [None, 1.0, 1.0, 1.0]), (304, [0.0] * 4), (None, [1.0, 0.0, 0.0, 0.0]), (5, [9.0, 9.0, 9.0, 9.1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    index = built(spark, df, tmp_path / "i", lists=9, parts=2)
    assert index.rows().count() == 303
    asked = df.where("vec_id IN (5, 250, 300, 304) OR vec_id IS NULL")
    found = ann.search(index, asked, 3, probes=9, refine=400).collect()
    own = [r for r in found if r.query_id == 250]
    assert [(r.rank, r.vec_id, r.score) for r in own] == [(1, 200, 1.0), (2, 201, 1.0), (3, 202, 1.0)]
    assert sum(r.query_id == 5 for r in found) == 6 and all(r.vec_id != 5 for r in found if r.query_id == 5)  # two rows of one id ask
    assert {r.score for r in found if r.query_id == 304} == {0.0} and not [r for r in found if r.query_id == 300]
    assert sum(r.query_id is None for r in found) == 3
    none = df.where("vec_id = -1")
    hollow = ann.add(ann.create(spark, str(tmp_path / "none"), ann.fit(none)), none)
    assert ann.search(hollow, asked, 3).collect() == []


def test_additions_leave_files_alone_and_searches_read_their_lists(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = ann.add(ann.create(spark, str(tmp_path / "i"), ann.fit(v, lists=10)), v.where("vec_id < 300"))
    before = set(index.rows().inputFiles())
    again = ann.add(ann.load(spark, str(tmp_path / "i")), v.where("vec_id >= 300"))
    assert before < set(again.rows().inputFiles()) and again.rows().count() == v.count()
    assert np.array_equal(again.model.centroids, index.model.centroids) and again.model.probes == index.model.probes
    got = ann.search(again, v.where("vec_id IN (10, 400)"), 4, probes=10, refine=600).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, search.similar(v, v.where("vec_id IN (10, 400)"), 4).collect()))
    plan = ann.search(again, v.where("vec_id = 10"), 4, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list#" in plan or "PartitionFilters: [isnotnull(list" in plan


def test_codes_come_near_their_vectors():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 10)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = ann.Model(ann.lloyd(x, 20, 10, 1), np.zeros((5, 1, 2), np.float32))
    lists = coarse.assigned(x)
    rest = coarse.split(x - coarse.centroids[lists])
    model = ann.Model(coarse.centroids, np.stack([ann.lloyd(rest[:, j], 256, 10, j) for j in range(5)]))
    back = model.centroids[lists] + np.stack([model.codebooks[j][model.coded(x, lists)[:, j]] for j in range(5)], 1).reshape(len(x), -1)[:, :10]
    assert np.square(back - x).sum(1).mean() < 0.05 < np.square(model.centroids[lists] - x).sum(1).mean()
    assert 1 <= ann.probes_for(coarse, x, 0.5) < ann.probes_for(coarse, x, 0.97) <= 20


def test_a_sample_is_bounded_and_the_same_in_any_run(spark):
    df = spark.range(5000).withColumnRenamed("id", "vec_id")
    one, two = (sorted(r.vec_id for r in ann.bounded_sample(df.repartition(n), 100, "vec_id").collect()) for n in (2, 7))
    assert one == two and len(one) == 100 and df.where(F.col("vec_id").isin(one)).count() == 100
