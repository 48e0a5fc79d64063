"""Clustering, projection and reduction of vectors by pyspark.ml. Seeds are fixed; results are tested by their invariants."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.operators import tree_clusters
from marigold.operators.stats import dimension_mode

#: Cluster centres that the driver holds; for more, a tree of clusters.
MAX_CENTRES = 10_000


def suggest_k(n: int) -> int:
    """The square root of n, halves up, within 3 and 12."""
    return min(12, max(3, math.floor(math.sqrt(n) + 0.5)))


def suggested_k(sizes: DataFrame, size_col: str) -> DataFrame:
    """sizes with suggest_k() of their column: each table's or group's own k, by the bounds that the function itself gives."""
    least, most = suggest_k(0), suggest_k(1 << 40)
    steps = [next(n for n in range(1 << 10) if suggest_k(n) >= k) for k in range(least + 1, most + 1)]
    return sizes.withColumn("k", sum((F.when(F.col(size_col) >= n, 1).otherwise(0) for n in steps), F.lit(least)).cast("int"))


def sanitize(df: DataFrame, *, vector_col: str = "embedding", prefer: str = "larger") -> DataFrame:
    """df with vectors of the most frequent length: padded by zeros or cut, non-finite values 0. Null vectors go."""
    mode = dimension_mode(df, vector_col, prefer).first()
    if mode is None:
        return df.where(F.lit(False))
    return df.where(F.col(vector_col).isNotNull()).withColumn(vector_col, vectors.sanitized(F.col(vector_col), int(mode["dimension"])))


def _featured(df: DataFrame, vector_col: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.transform(F.col(vector_col), lambda x: x.cast("double"))))


def kmeans(df: DataFrame, k: int, *, vector_col: str = "embedding", cosine: bool = True, seed: int = 42, rounds: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, list[list[float]]]:
    """df with `cluster`, and the k centres. Cosine clustering leaves out zero vectors, which have no direction."""
    rows = _featured(df, vector_col)
    if cosine:
        rows = rows.where(vectors.norm(F.col(vector_col)) > 0)
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=tolerance, distanceMeasure="cosine" if cosine else "euclidean", featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_v"), [list(map(float, c)) for c in model.clusterCenters()]


def silhouette_scan(df: DataFrame, ks: list[int], *, vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(k, silhouette, best): Euclidean k-means for each k, by squared-Euclidean silhouette."""
    rows = _featured(df, vector_col).select("_v").persist()
    evaluator = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
    scores = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
        scores.append((k, float(evaluator.evaluate(model.transform(rows)))))
    rows.unpersist()
    top = max(scores, key=lambda s: (s[1], -s[0]))[0] if scores else None
    return df.sparkSession.createDataFrame([(k, s, k == top) for k, s in scores], "k int, silhouette double, best boolean")


def _clustered(df: DataFrame, k: int, vector_col: str, seed: int) -> DataFrame:
    """df with `cluster` and the `distance` to its centre; beyond MAX_CENTRES by a tree of clusters, whose centres are a table."""
    if k > MAX_CENTRES:
        return tree_clusters.tree_kmeans(df, k, vector_col=vector_col, seed=seed)[0]
    clustered, centres = kmeans(df, k, vector_col=vector_col, cosine=False, seed=seed)
    table = df.sparkSession.createDataFrame(list(enumerate(centres)), "cluster int, _centre array<double>")
    return clustered.join(table, "cluster").withColumn("distance", vectors.squared_distance(F.col(vector_col), F.col("_centre"))).drop("_centre")


def _closest(far: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """(cluster, size, row): the row closest to each centre, ties to the smaller id; combined before the shuffle, whatever a cluster's size."""
    return far.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by(F.struct(*columns), F.struct("distance", id_col)).alias("row"))


def reduce_near_duplicates(df: DataFrame, threshold: float = 0.85, *, min_size: int = 2, vector_col: str = "embedding", id_col: str = "vec_id", seed: int = 42) -> DataFrame:
    """df without members of clusters of at least min_size but the one closest to the centre. The threshold only sets the number of
    clusters, a tenth of the share of rows above it, 50 at least and half the rows at most; it is not a bound on pairs."""
    k = reduced_k(df.count(), threshold)
    if k < 1:
        return df
    far = _clustered(df, k, vector_col, seed)
    closest = _closest(far, df.columns, id_col)
    if min_size <= 2:
        return closest.select("row.*")
    small = far.join(closest.where(F.col("size") < min_size).select("cluster"), "cluster", "left_semi")
    return closest.where(F.col("size") >= min_size).select("row.*").unionAll(small.select(*df.columns))


def reduced_k(n: int, threshold: float) -> int:
    """The number of clusters to which near-duplicate removal of n rows leads."""
    return min(max(50, int(n * (1 - threshold) * 0.1)), n // 2)


def decimate(df: DataFrame, target: int, *, vector_col: str = "embedding", id_col: str = "vec_id", seed: int = 42) -> DataFrame:
    """`target` representatives: the row closest to each of `target` centres."""
    if df.count() <= target:
        return df
    return _closest(_clustered(df, target, vector_col, seed), df.columns, id_col).select("row.*")


def cluster_profile(clustered: DataFrame, axis: str, id_col: str, samples: int = 3) -> DataFrame:
    """(cluster, size, axes, samples): size, counts by axis and the first ids of each cluster."""
    counts = clustered.groupBy("cluster", axis).agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(axis, "n")))).alias("axes"))
    w = Window.partitionBy("cluster").orderBy(id_col)
    few = clustered.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples).groupBy("cluster").agg(F.array_sort(F.collect_list(id_col)).alias("samples"))
    return counts.join(few, "cluster")


@dataclass(frozen=True)
class Projection:
    """A fitted projection: mean, loadings with signs, range of each component, and the share of variance that it explains."""

    mean: list[float]
    loadings: list[list[float]]
    ranges: list[tuple[float, float]]
    explained: list[float]

    def scaled(self, values: Column) -> Column:
        """Component values scaled to [-1, 1] by the fitted ranges, clamped."""
        return F.array(*(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (values[j] - lo) / (hi - lo or 1.0) * 2 - 1)) for j, (lo, hi) in enumerate(self.ranges)))

    def of(self, vector: Column) -> Column:
        """The projection of a vector that need not be among the fitted ones; null for vectors of another length."""
        centred = F.zip_with(vector, F.array(*(F.lit(m) for m in self.mean)), lambda x, m: x.cast("double") - m)
        values = F.array(*(vectors.dot(centred, F.array(*(F.lit(x) for x in pc))) for pc in self.loadings))
        return F.when(F.size(vector) == len(self.mean), self.scaled(values))


def pca(df: DataFrame, k: int = 3, *, vector_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, list[float]]:
    """(id, projection) scaled to [-1, 1] per component, and the explained share of each component.

    Vectors are centred first; each component's sign is that of its largest loading."""
    projected, fitted = fit_pca(df, k, vector_col=vector_col, id_col=id_col)
    return projected, fitted.explained


def fit_pca(df: DataFrame, k: int = 3, *, vector_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, Projection]:
    """As pca, with the fitted projection for new vectors."""
    mode = dimension_mode(df, vector_col).first()
    if mode is None:
        return df.select(id_col, F.array().cast("array<double>").alias("projection")), Projection([], [], [], [])
    d = int(mode["dimension"])
    rows = df.where(F.size(vector_col) == d)
    mean = rows.agg(*(F.avg(F.col(vector_col)[i]).alias(f"m{i}") for i in range(d))).first()
    centred = rows.select(id_col, F.array(*(F.col(vector_col)[i].cast("double") - F.lit(float(mean[i])) for i in range(d))).alias("c"))
    model = PCA(k=min(k, d), inputCol="_v", outputCol="_p").fit(_featured(centred, "c"))
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loadings.shape[1])]
    projected = model.transform(_featured(centred, "c")).select(id_col, vector_to_array("_p").alias("p"))
    signed = projected.select(id_col, F.array(*(F.col("p")[j] * s for j, s in enumerate(signs))).alias("p"))
    ranges = signed.agg(*(f(F.col("p")[j]).alias(f"{n}{j}") for j in range(len(signs)) for n, f in (("lo", F.min), ("hi", F.max)))).first()

    fitted = Projection(
        [float(x) for x in mean], [[float(x) * s for x in loadings[:, j]] for j, s in enumerate(signs)], [(float(ranges[f"lo{j}"]), float(ranges[f"hi{j}"])) for j in range(len(signs))], [float(x) for x in model.explainedVariance]
    )
    return signed.select(id_col, fitted.scaled(F.col("p")).alias("projection")), fitted


def nearest_centroid(df: DataFrame, centroids: DataFrame, *, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", limit: int = 10_000) -> DataFrame:
    """(id, nearest, score): the centroid of highest cosine, ties to the smaller label. Centroids are broadcast; their number is checked."""
    if centroids.limit(limit + 1).count() > limit:
        raise ValueError(f"at most {limit} centroids")
    listed = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(label_col).alias("nearest"), "centroid"))).alias("_c"))  # one row
    score = lambda c: F.round(vectors.cosine(F.col(vector_col), c["centroid"]), 6)
    best = F.array_min(F.transform("_c", lambda c: F.struct((-score(c)).alias("s"), c["nearest"].alias("nearest"))))
    scored = df.where(F.col(vector_col).isNotNull()).join(F.broadcast(listed)).select(id_col, best.alias("_b"))
    return scored.where("_b IS NOT NULL").select(id_col, "_b.nearest", (-F.col("_b.s")).alias("score"))


def prototypes(df: DataFrame, dimension: int, *, vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(label, centroid): mean of the unit vectors of each label."""
    return df.where(F.col(vector_col).isNotNull() & F.col(label_col).isNotNull()).withColumn("_u", vectors.unit(F.col(vector_col))).groupBy(label_col).agg(vectors.mean_vector(F.col("_u"), dimension).alias("centroid"))
