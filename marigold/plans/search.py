"""Search queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.operators import ml, search, stats
from marigold.registry import query, table

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def _cos(a: str, b: str) -> str:
    return f"round({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}) + 1e-9::DOUBLE), 6)"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0, the query of these searches."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, {_cos('embedding', 'q.v')} AS score FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY score DESC, vec_id LIMIT 10
""")
def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10).select("vec_id", "label", "score")


@query(f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), n AS (SELECT sqrt({_dot('v', 'v')}) + 1e-12::DOUBLE AS qn, v FROM q)
SELECT vec_id, round({_dot('embedding', 'n.v')} / ((sqrt({_dot('embedding', 'embedding')}) + 1e-12::DOUBLE) * qn), 6) AS score FROM embeddings, n ORDER BY score DESC, vec_id LIMIT 20
""")
def vec_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inner_product_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 20).select("vec_id", "score")


_SIMILAR = f"""
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_cos('c.embedding', 'q.embedding')} AS score FROM embeddings c JOIN embeddings q ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
"""


@query(f"WITH {_SIMILAR} SELECT * FROM r WHERE rank <= 5")
def vec_similar_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.similar(v, v.where("vec_id % 20 = 0"), 5)


@query(f"""
WITH {_SIMILAR}, v AS (SELECT query_id, label, round(sum(greatest(0, score)), 6) AS weight FROM r JOIN embeddings USING (vec_id) WHERE rank <= 12 AND label IS NOT NULL GROUP BY ALL)
SELECT query_id, label, weight FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, label) = 1
""")
def vec_label_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.infer_label(v, v.where("vec_id % 20 = 0"), 12)


@query("SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY n DESC, dimension DESC LIMIT 1")
def vec_dim_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dimension_mode(table(spark, sf_dir, "embeddings"), "embedding")


@query("""
SELECT vec_id, CAST(len(s) AS INTEGER) AS n, round(list_sum(s), 6) AS total FROM
(SELECT vec_id, list_transform(range(1, 71), lambda i: CASE WHEN i > len(embedding) OR embedding[i] IS NULL OR NOT isfinite(embedding[i]) THEN 0.0::DOUBLE ELSE CAST(embedding[i] AS DOUBLE) END) AS s FROM embeddings)
""")
def vec_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.sanitized(F.col("embedding"), 70).alias("s"))
    return v.select("vec_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
SELECT label, CAST(i AS INTEGER) AS component, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i
""")
def vec_centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").groupBy("label").agg(vectors.mean_vector(F.col("embedding"), 64).alias("c"))
    return v.select("label", F.posexplode("c").alias("component", "m")).select("label", "component", F.round("m", 6).alias("mean"))


_PROTOTYPES = f"""
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt({_dot('embedding', 'embedding')}) + 1e-12::DOUBLE)) AS u FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(u) AS x, unnest(range(64)) AS i FROM u) GROUP BY label, i),
c AS (SELECT label AS nearest, list(x ORDER BY i) AS centroid FROM m GROUP BY label)
"""


@query(f"""
WITH {_PROTOTYPES}, s AS (SELECT vec_id, nearest, {_cos('embedding', 'centroid')} AS score FROM embeddings, c)
SELECT vec_id, nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) = 1
""")
def vec_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return ml.nearest_centroid(v, ml.prototypes(v, 64))


_SHA_TOKENS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS t FROM documents"
_SHA_BUCKET = "CAST(('0x' || substr(sha256(t), 63, 2))::INTEGER % 64 AS INTEGER)"


@query(f"""
WITH c AS (SELECT doc_id, {_SHA_BUCKET} AS bucket, count(*) AS n FROM ({_SHA_TOKENS}) GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c
""")
def hash_embed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hash_embedding_buckets(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


_FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS t FROM documents),
c AS (SELECT doc_id, ({_FNV}) % 64 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL), m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
q AS (SELECT b, n / norm AS x FROM c JOIN m USING (doc_id) WHERE doc_id = 0),
s AS (SELECT c.doc_id, round(coalesce(sum(c.n * q.x), 0) / any_value(m.norm), 6) AS score FROM c JOIN m USING (doc_id) LEFT JOIN q USING (b) GROUP BY c.doc_id)
SELECT doc_id, score FROM s WHERE doc_id <> 0 ORDER BY score DESC, doc_id LIMIT 10
""")
def text_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_neighbours(table(spark, sf_dir, "documents"), 0, 10)


SQL_AND = "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '\\s+'), ['the', 'of'])"


@query(SQL_AND)
def kw_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_filter(table(spark, sf_dir, "documents"), ["the", "of"]).select("doc_id")


SQL_HYBRID = f"""
WITH w AS ({_SHA_TOKENS} WHERE list_has_all(regexp_split_to_array(lower(text), '\\s+'), ['the', 'and'])),
c AS (SELECT doc_id, {_SHA_BUCKET} AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
q AS (SELECT b, n / sqrt(sum(n * n) OVER ()) AS x FROM (SELECT {_SHA_BUCKET} AS b, count(*)::DOUBLE AS n FROM (SELECT unnest(['the', 'tion', 'of', 'and', 'and']) AS t) GROUP BY 1)),
s AS (SELECT c.doc_id, round(coalesce(sum(c.n * q.x), 0) / sqrt(sum(c.n * c.n)), 6) AS score FROM c LEFT JOIN q USING (b) GROUP BY c.doc_id)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 25
"""


@query(SQL_HYBRID)
def kw_and_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(table(spark, sf_dir, "documents"), ["the", "and"], "the tion of and and", 25)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'src1') OR contains(lower(source), 'src1') OR contains(lower(lang), 'src1')")
def text_multi_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.any_column_contains(table(spark, sf_dir, "documents"), "SRC1", ["text", "source", "lang"]).select("doc_id")


@query("""
WITH a AS (SELECT p_partkey, list_concat([p_name], regexp_extract_all(p_name, '\\(([^)]+)\\)', 1)) AS names FROM part)
SELECT p_partkey FROM a WHERE len(list_filter(names, lambda x: contains(lower(trim(x)), '1'))) > 0 AND len(list_filter(names, lambda x: regexp_matches(trim(x), '2$', 'i'))) > 0
""")
def text_regex_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.alias_match(table(spark, sf_dir, "part"), "p_name", contains="1", regex="2$").select("p_partkey")


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) AS w FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) AS w FROM benchmark),
s AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN w USING (w) GROUP BY ALL)
SELECT query_id, doc_id, overlap FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) <= 3
""")
def token_overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.word_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 3)


@query("""
WITH c AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t IN ('the', 'of', 'and'))) AS matches FROM documents)
SELECT doc_id, CAST(matches AS BIGINT) AS matches FROM c WHERE matches > 0 ORDER BY matches DESC, doc_id LIMIT 20
""")
def text_bow_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = stats.lexicon_rates(table(spark, sf_dir, "documents"), ["the", "of", "and"], id_col="doc_id", text_col="text")
    return rates.where("hits > 0").select("doc_id", F.col("hits").alias("matches")).orderBy(F.desc("matches"), "doc_id").limit(20)
