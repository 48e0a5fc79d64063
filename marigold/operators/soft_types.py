"""Soft types: a mixture on unit vectors, started from prototypes, by expectation maximisation.

A type's density at a unit vector x is proportional to exp(concentration * <mean, x>), one given concentration for all types.
Each round is one pass: responsibilities inside the row, sums per type combined before the shuffle, types times components to the driver.
A round maximises exactly, so the likelihood never falls.

Results: vectors that are null, of another length, with components that are not numbers, or zero have no type (null); they do not take
part in the fit. The number of types is bounded by MAX_TYPES. A type that no vector leans to keeps its mean with weight 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.operators import ml

MAX_TYPES = 1024


@dataclass(frozen=True)
class SoftTypes:
    labels: list
    means: list[list[float]]
    weights: list[float]
    concentration: float
    likelihoods: tuple[float, ...] = ()  # mean of log sum_k weight_k exp(concentration <mean_k, x>) before each round

    def table(self, spark: SparkSession) -> DataFrame:
        """One row: the types in order."""
        kind = "_types array<struct<label:string,mean:array<double>,bias:double>>"
        return spark.createDataFrame([([(str(n), m, math.log(w) if w > 0 else -1e300) for n, m, w in zip(self.labels, self.means, self.weights, strict=True)],)], kind)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a column that a lambda refers to would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _direction(vector: Column, d: int) -> Column:
    usable = vector.isNotNull() & (F.size(vector) == d) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (vectors.norm(vector) > 0)
    return F.when(usable, vectors.unit(vector))


def _leaning(df: DataFrame, fitted: SoftTypes, vector_col: str) -> DataFrame:
    """df with `_x`, its direction, `_r`, its responsibilities, and `_l`, its log likelihood; null without a direction."""
    d = len(fitted.means[0])
    table = F.broadcast(fitted.table(df.sparkSession))  # one row of at most MAX_TYPES means
    rows = df.withColumn("_x", _direction(F.col(vector_col), d)).join(table)
    scores = lambda x: F.transform("_types", lambda t: t["bias"] + fitted.concentration * vectors.dot(x, t["mean"]))
    shares = lambda e, m: _let(_total(e), lambda z: F.struct(F.transform(e, lambda v: v / z).alias("r"), (m + F.log(z)).alias("l")))
    raised = lambda s: _let(F.array_max(s), lambda m: _let(F.transform(s, lambda v: F.exp(v - m)), lambda e: shares(e, m)))
    lean = _let(F.col("_x"), lambda x: F.when(x.isNotNull(), _let(scores(x), raised)))
    return rows.withColumn("_lean", lean).select("*", F.col("_lean.r").alias("_r"), F.col("_lean.l").alias("_l")).drop("_lean")


def start(df: DataFrame, *, concentration: float, vector_col: str = "embedding", label_col: str = "label") -> SoftTypes:
    """Types of equal weight at the prototypes of the labels: the directions of their mean unit vectors."""
    mode = ml.dimension_mode(df.where(F.col(label_col).isNotNull()), vector_col).first()
    if mode is None:
        raise ValueError("no labelled vectors")
    d = int(mode["dimension"])
    usable = df.where(_direction(F.col(vector_col), d).isNotNull())
    rows = sorted(ml.prototypes(usable, d, vector_col=vector_col, label_col=label_col).limit(MAX_TYPES + 1).collect())
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    kept = [(r[label_col], [x / n for x in r["centroid"]]) for r in rows if (n := math.sqrt(sum(x * x for x in r["centroid"]))) > 0]
    return SoftTypes([n for n, _ in kept], [m for _, m in kept], [1 / len(kept)] * len(kept), concentration)


def fit(df: DataFrame, begun: SoftTypes, *, rounds: int = 10, vector_col: str = "embedding") -> SoftTypes:
    """begun after some rounds over all vectors of df."""
    d, fitted = len(begun.means[0]), begun
    for _ in range(rounds):
        leaning = _leaning(df.select(vector_col), fitted, vector_col).where("_x IS NOT NULL").select("_x", "_l", F.posexplode("_r").alias("_t", "_p"))
        sums = leaning.groupBy("_t").agg(F.sum("_p").alias("n"), F.count("*").alias("rows"), F.sum("_l").alias("l"), F.expr(f"array({', '.join(f'sum(_p * _x[{i}])' for i in range(d))})").alias("s")).collect()
        if not sums:
            break
        means, weights = list(fitted.means), list(fitted.weights)
        for r in sums:
            size = math.sqrt(sum(x * x for x in r["s"]))
            weights[r["_t"]] = r["n"] / r["rows"]
            if size > 0:
                means[r["_t"]] = [x / size for x in r["s"]]
        fitted = replace(fitted, means=means, weights=weights, likelihoods=(*fitted.likelihoods, sums[0]["l"] / sums[0]["rows"]))
    return fitted


def typed(df: DataFrame, fitted: SoftTypes, *, vector_col: str = "embedding", temperature: float = 1.0) -> DataFrame:
    """df with `types`, an array of (label, probability) in the order of labels, `type`, the most probable (ties to the first), and
    `entropy` in nats. Probabilities are those of the mixture to the power of 1 / temperature, normalised."""
    power = lambda r: F.transform(r, lambda v: F.pow(v, 1 / temperature))
    rows = _leaning(df, fitted, vector_col).withColumn("_r", _let(power(F.col("_r")), lambda r: _let(_total(r), lambda z: F.transform(r, lambda v: v / z))))
    rows = rows.withColumn("types", F.zip_with("_types", "_r", lambda t, r: F.struct(t["label"].alias("label"), r.alias("probability"))))
    rows = rows.withColumn("types", F.when(F.col("_r").isNotNull(), F.col("types")))
    top = F.get(F.col("types"), F.array_position("_r", F.array_max("_r")).cast("int") - 1)["label"]
    entropy = F.aggregate("_r", F.lit(0.0), lambda a, r: a - F.when(r > 0, r * F.log(r)).otherwise(0.0))
    return rows.select(*df.columns, "types", top.alias("type"), entropy.alias("entropy"))
