"""Agreement against definitions computed pair by pair."""

from __future__ import annotations

import itertools
import math
import random
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marigold.operators import agreement


def by_pairs(units: dict, metric: str) -> float:
    """Krippendorff's alpha from its definition: every pair of ratings."""
    units = {u: x for u, x in units.items() if len(x) > 1}
    values = [v for x in units.values() for v in x]
    counts, order = Counter(values), sorted(set(values))

    def distance(a, b) -> float:
        if a == b:
            return 0.0
        if metric == "nominal":
            return 1.0
        if metric == "interval":
            return (a - b) ** 2
        between = [v for v in order if min(a, b) <= v <= max(a, b)]
        return (sum(counts[v] for v in between) - (counts[a] + counts[b]) / 2) ** 2

    observed = sum(distance(a, b) / (len(x) - 1) for x in units.values() for a, b in itertools.permutations(x, 2)) / len(values)
    expected = sum(distance(a, b) for a, b in itertools.permutations(values, 2)) / (len(values) * (len(values) - 1))
    return 1.0 if expected == 0 else 1 - observed / expected


@pytest.fixture(scope="module")
def ratings(spark):
    rnd = random.Random(6)
    rows = [(u, w, f"r{j}", min(5, max(1, u % 5 + rnd.choice([0, 0, 0, 1, -1, 2])))) for u in range(40) for w in (10, 11, 13) for j in range(rnd.randint(1, 5))]
    rows += [(None, 10, "r0", 3), (3, 10, "r9", None), (999, 11, "r1", 2)]
    return spark.createDataFrame(rows, "u long, week int, rater string, v int").repartition(3)


def grouped(ratings, *keys: str) -> dict:
    out = defaultdict(list)
    for r in ratings.dropna().collect():
        out[tuple(r[k] for k in keys)].append(r.v)
    return out


@pytest.mark.parametrize("metric", ["nominal", "ordinal", "interval"])
def test_alpha_of_all_and_of_weeks(ratings, metric):
    whole = agreement.alpha(agreement.coincidences(ratings, unit="u", value="v"), metric).first()
    assert whole.alpha == pytest.approx(by_pairs(grouped(ratings, "u"), metric), abs=2e-6)
    cells = grouped(ratings, "week", "u")
    of = lambda weeks: by_pairs({k: x for k, x in cells.items() if k[0] in weeks}, metric)
    got = {r.week: r for r in agreement.weekly_reliability(ratings, unit="u", value="v", week="week", metric=metric, threshold=0.5).collect()}
    assert set(got) == {10, 11, 13}
    for week, span in ((10, {10}), (11, {10, 11}), (13, {11, 13})):
        assert got[week].alpha == pytest.approx(of({week}), abs=2e-6) and got[week].merged == pytest.approx(of(span), abs=2e-6)
        mean = sum(of({w}) for w in span) / len(span)
        assert got[week].moving == pytest.approx(mean, abs=3e-6) and got[week].recalibrate == (got[week].moving < 0.5)


def test_edges_of_alpha(spark, ratings):
    none = ratings.where("u = -1")
    assert agreement.alpha(agreement.coincidences(none, unit="u", value="v")).collect() == []
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "a")], "u long, v string")
    assert agreement.alpha(agreement.coincidences(same, unit="u", value="v")).first().alpha == 1.0
    assert agreement.bootstrap_alpha(same, unit="u", value="v", replicates=5).first().low == 1.0
    with pytest.raises(ValueError):
        agreement.coincidences(spark.range(2000).select("id", F.col("id").alias("v")), unit="id", value="v")
    with pytest.raises(ValueError):
        agreement.alpha(agreement.coincidences(same, unit="u", value="v"), "other")


def test_bootstrap_resamples_units(ratings):
    units = {u: x for (u,), x in grouped(ratings, "u").items() if len(x) > 1}
    bounds = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]
    found = []
    for r in range(50):
        drawn = {}
        for u, x in units.items():
            d = int(hashlib.md5(f"{u}:{r}".encode()).hexdigest()[:8], 16) / 2**32
            drawn |= {(u, i): x for i in range(sum(d >= b for b in bounds))}
        found.append(by_pairs(drawn, "nominal"))
    got = agreement.bootstrap_alpha(ratings, unit="u", value="v", replicates=50).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(found, [0.025, 0.975])), abs=2e-6) and got.replicates == 50
    weights = [r.w for r in ratings.sparkSession.range(20_000).select(agreement.poisson_weight([F.col("id")]).alias("w")).collect()]
    assert np.mean(weights) == pytest.approx(1, abs=0.03) and np.var(weights) == pytest.approx(1, abs=0.06)


def test_two_way_intraclass_correlation(spark):
    # six targets by four judges: a textbook table, with a far mean added that must not cost digits
    table = np.array([[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]], float)
    for shift in (0.0, 1e9):
        rows = [(t, j, float(table[t, j] + shift)) for t in range(6) for j in range(4)] + [(7, 0, 3.0 + shift), (8, 1, None)]
        got = agreement.icc_two_way(spark.createDataFrame(rows, "t long, j long, x double"), unit="t", rater="j", value="x").first()
        assert (round(got.icc_agreement, 2), round(got.icc_consistency, 2), got.units, got.raters, got.incomplete) == (0.29, 0.71, 6, 4, 1)
    none = agreement.icc_two_way(spark.createDataFrame([], "t long, j long, x double"), unit="t", rater="j", value="x").first()
    assert none.icc_agreement is None and none.units == 0
