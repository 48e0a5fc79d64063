"""Clustering, projection and reduction on the driver's tables. Seeds are fixed; tests check invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import geometry
from marigold.operators import ml, soft_types, tree_clusters
from marigold.registry import query, table


@query()
def pca_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected, _ = ml.pca(table(spark, sf_dir, "embeddings"), 3)
    return projected.select("vec_id", *(F.round(F.col("projection")[i], 6).alias(f"p{i + 1}") for i in range(3)))


@query()
def kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ml.sanitize(table(spark, sf_dir, "embeddings"))
    clustered, _ = ml.kmeans(vectors, ml.suggest_k(vectors.count()))
    return clustered.select("vec_id", "cluster")


@query()
def kmeans_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, _ = ml.kmeans(table(spark, sf_dir, "embeddings"), 8)
    return ml.cluster_profile(clustered, "label", "vec_id").select("cluster", "size", F.to_json("axes").alias("axes"), "samples")


@query("""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) + 1e-12)) AS x FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT label, i, avg(c) AS m FROM (SELECT label, unnest(range(len(x))) AS i, unnest(x) AS c FROM u WHERE label IS NOT NULL) GROUP BY ALL),
c AS (SELECT label, list(m / n ORDER BY i) AS m FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM p) GROUP BY label),
s AS (SELECT vec_id, c.label::VARCHAR AS label, exp(8 * list_sum(list_transform(list_zip(x, m), lambda z: z[1] * z[2]))) AS e FROM u, c),
r AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s)
SELECT vec_id, label, round(p, 6) AS probability FROM r
""")
def soft_types_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's probability of each label, by its prototype."""
    v = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    typed = soft_types.typed(v, soft_types.start(v, concentration=8.0))
    return typed.select("vec_id", F.inline("types")).select("vec_id", "label", F.round("probability", 6).alias("probability"))


@query()
def soft_types_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types after five rounds of expectation maximisation; tests hold rounds against numpy."""
    v = table(spark, sf_dir, "embeddings")
    return soft_types.typed(v, soft_types.fit(v, soft_types.start(v, concentration=8.0), rounds=5)).select("vec_id", "type", "entropy")


@query("SELECT count(*) AS rows, least(200, count(DISTINCT embedding)) AS clusters, true AS whole FROM embeddings WHERE embedding IS NOT NULL")
def tree_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of 200 clusters: every vector in one, sizes as the table of centres has them."""
    rows, centres = tree_clusters.tree_kmeans(table(spark, sf_dir, "embeddings"), 200, rounds=2)
    counted = rows.groupBy("cluster").agg(F.count("*").alias("n")).join(centres, "cluster")
    return counted.agg(F.sum("n").alias("rows"), F.count("*").alias("clusters"), F.coalesce(F.bool_and(F.col("n") == F.col("size")), F.lit(True)).alias("whole"))


def scanned_k(n: int) -> list[int]:
    """The numbers of clusters that the silhouette scan of n vectors tries."""
    return list(range(50, min(200, n // 2) + 1, 25)) or [2]


@query()
def kmeans_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ml.silhouette_scan(vectors, scanned_k(vectors.count()))


@query()
def dedup_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.reduce_near_duplicates(table(spark, sf_dir, "embeddings"), 0.2).select("vec_id")


@query()
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.decimate(table(spark, sf_dir, "embeddings"), 25).select("vec_id")


_STACK = ", ".join(f"('{t}', {i}, '{f[0] in 'NS'}', '{f[1] == 'e'}', {w})" for t, stack in geometry.STACKS.items() for i, (f, w) in enumerate(zip(stack.split(), (0.5, 0.3, 0.15, 0.05), strict=True)))
_TYPES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(geometry.CODES.values()))


@query(f"""
WITH t AS (SELECT vec_id, mbti FROM embeddings JOIN (VALUES {_TYPES}) AS t(i, mbti) ON vec_id % 16 = i),
v AS (SELECT vec_id, mbti, CASE WHEN mbti[1] = 'E' THEN 0.5::DOUBLE ELSE -0.5 END AS a, CASE WHEN mbti[2] = 'N' THEN 0.5::DOUBLE ELSE -0.5 END AS b, CASE WHEN mbti[3] = 'F' THEN 0.5::DOUBLE ELSE -0.5 END AS c, CASE WHEN mbti[4] = 'P' THEN 0.5::DOUBLE ELSE -0.5 END AS d FROM t),
h AS (SELECT vec_id, mbti, 2 * (a*c + b*d) AS x, 2 * (b*c - a*d) AS y, (a*a + b*b) - (c*c + d*d) AS z FROM v),
p AS (SELECT vec_id, mbti, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, CASE WHEN x*x+y*y+z*z = 0 THEN 1 ELSE sqrt(x*x+y*y+z*z) END AS l FROM h)),
n AS (SELECT p.*, w::DOUBLE AS w, CASE WHEN extra = 'True' THEN 0.1::DOUBLE ELSE -0.1 END AS roll, CASE WHEN side = 'True' THEN 0 ELSE 1 END::DOUBLE AS nx, CASE WHEN side = 'True' THEN 1 ELSE 0 END::DOUBLE AS ny, 0::DOUBLE AS nz FROM p JOIN (VALUES {_STACK}) AS s(type, role, side, extra, w) ON type = mbti),
k AS (SELECT *, sqrt(pow(ny*z - nz*y, 2) + pow(nz*x - nx*z, 2) + pow(nx*y - ny*x, 2)) < 1e-6 AS flat FROM n),
j AS (SELECT * REPLACE (CASE WHEN flat THEN nx + 1e-3 ELSE nx END AS nx, CASE WHEN flat THEN ny - 1e-3 ELSE ny END AS ny, CASE WHEN flat THEN nz + 2e-3 ELSE nz END AS nz) FROM k),
u AS (SELECT vec_id, x, y, z, w, roll, ux / l AS ux, uy / l AS uy, uz / l AS uz FROM (SELECT *, ny*z - nz*y AS ux, nz*x - nx*z AS uy, nx*y - ny*x AS uz, sqrt(pow(ny*z - nz*y, 2) + pow(nz*x - nx*z, 2) + pow(nx*y - ny*x, 2)) AS l FROM j)),
r AS (SELECT *, ux*cos(roll) + (y*uz - z*uy)*sin(roll) + x*(1-cos(roll))*(x*ux+y*uy+z*uz) AS rx, uy*cos(roll) + (z*ux - x*uz)*sin(roll) + y*(1-cos(roll))*(x*ux+y*uy+z*uz) AS ry, uz*cos(roll) + (x*uy - y*ux)*sin(roll) + z*(1-cos(roll))*(x*ux+y*uy+z*uz) AS rz FROM u),
s AS (SELECT vec_id, x, y, z, -sum(w * rx / sqrt(rx*rx+ry*ry+rz*rz)) AS ax, -sum(w * ry / sqrt(rx*rx+ry*ry+rz*rz)) AS ay, -sum(w * rz / sqrt(rx*rx+ry*ry+rz*rz)) AS az FROM r GROUP BY ALL),
g AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS size FROM s),
e AS (SELECT *, least(size, radians(12)) AS turn, ay*z - az*y AS ex, az*x - ax*z AS ey, ax*y - ay*x AS ez FROM g),
f AS (SELECT vec_id, x, y, z, turn, ex / l AS ex, ey / l AS ey, ez / l AS ez FROM (SELECT *, sqrt(ex*ex+ey*ey+ez*ez) AS l FROM e)),
m AS (SELECT vec_id, x*cos(turn) + (ey*z - ez*y)*sin(turn) AS x, y*cos(turn) + (ez*x - ex*z)*sin(turn) AS y, z*cos(turn) + (ex*y - ey*x)*sin(turn) AS z FROM f)
SELECT vec_id, round(x / sqrt(x*x+y*y+z*z), 6) + 0.0::DOUBLE AS x, round(y / sqrt(x*x+y*y+z*z), 6) + 0.0::DOUBLE AS y, round(z / sqrt(x*x+y*y+z*z), 6) + 0.0::DOUBLE AS z FROM m
""")
def function_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types on the sphere, moved by their functions."""
    codes = F.array(*(F.lit(c) for c in geometry.CODES.values()))
    normals = {"N": (0.0, 1.0, 0.0), "F": (1.0, 0.0, 0.0)}
    typed = table(spark, sf_dir, "embeddings").select("vec_id", F.get(codes, (F.col("vec_id") % 16).cast("int")).alias("mbti"))
    moved = typed.withColumn("p", geometry.hopf(geometry.type_vector(F.col("mbti")))).withColumn("m", geometry.function_offset(F.col("p"), F.col("mbti"), normals))
    return moved.select("vec_id", *((F.round(F.col("m")[c], 6) + 0.0).alias(c) for c in "xyz"))
