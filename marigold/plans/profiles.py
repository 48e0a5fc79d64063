"""Profile queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import text
from marigold.operators import profiles, search
from marigold.registry import query, table


def _payload() -> F.Column:
    return F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("mbti_type")))


@query("""
SELECT c_custkey::VARCHAR AS cid, c_custkey AS pid, c_name AS name, c_mktsegment AS mbti, c_custkey IN (SELECT o_custkey FROM orders) AS has_vector FROM customer
""")
def export_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cid"), F.col("c_custkey").alias("i"), _payload().alias("payload"))
    vectors = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cid"))
    return profiles.export_profiles(raw, vectors, order="i").select("cid", "pid", "name", "mbti", "has_vector")


@query("SELECT DISTINCT n_nationkey, unnest([n_name || ' (' || lower(n_name) || ')', lower(n_name)]) AS name FROM nation")
def names_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" ("), F.lower("n_name"), F.lit(")")).alias("n"))
    return profiles.names_listing(named, id_col="n_nationkey", name_col="n")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '11') ORDER BY c_custkey LIMIT 20")
def ids_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.ids_by_name(table(spark, sf_dir, "customer"), "11", id_col="c_custkey", name_col="c_name")


_NAMED = "n AS (SELECT vec_id, 'vector ' || label::VARCHAR AS name FROM embeddings)"


@query(f"""
WITH {_NAMED}, q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, name, list_sum(list_transform(list_zip(embedding, v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS d,
list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS a, list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)) AS b FROM embeddings JOIN n USING (vec_id), q WHERE regexp_matches(name, '[13]$'))
SELECT vec_id, name, round(d / (sqrt(a) * sqrt(b) + 1e-9::DOUBLE), 6) AS score FROM d ORDER BY score DESC, vec_id LIMIT 8
""")
def search_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    names = v.select("vec_id", F.concat(F.lit("vector "), F.col("label").cast("string")).alias("name"))
    first = v.where("vec_id = 0").first()["embedding"]
    return profiles.search_named(v, names, first, 8, id_col="vec_id", name_col="name", regex="[13]$")


@query("""
SELECT event_id::VARCHAR AS cid, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 2 = 0 THEN c_name WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE '(unknown)' END AS name
FROM events LEFT JOIN customer ON c_custkey = event_id
""")
def refresh_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("cid"))
    customers = table(spark, sf_dir, "customer")
    characters = customers.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("cid"), F.col("c_name").alias("name"))
    payloads = customers.select(F.col("c_custkey").cast("string").alias("cid"), F.col("c_mktsegment").alias("name"))
    return profiles.refresh_names(ids, characters, payloads)


@query("""
WITH p AS (SELECT doc_id, source || ' | ' || lang AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '')) AS t FROM p),
c AS (SELECT doc_id, CAST(('0x' || substr(sha256(t), 63, 2))::INTEGER % 64 AS INTEGER) AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
SELECT doc_id, count(*) AS parts, round(sum(n / m * (b + 1)), 6) AS signature FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS m FROM c) GROUP BY doc_id
""")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for documents without a label, as the number of their parts and a weighted sum."""
    made = profiles.embed_pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["source", "lang"], "doc_id")
    parts = made.select("doc_id", F.posexplode("vector").alias("b", "x")).where("x <> 0")
    return parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.round(F.sum(F.col("x") * (F.col("b") + 1)), 6).alias("signature"))


@query("""
SELECT field, value, n FROM (SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 10
""")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.field_values(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("""
SELECT (SELECT count(*) FROM documents) AS n_profiles, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings)) AS n_both, (SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS dimension
""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return profiles.manifest(docs, table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), key="id", vector_col="embedding")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda n: F.struct((F.col("p_partkey") + n).cast("string").alias("id"), F.lit("x").alias("name"))
    payload = F.to_json(F.struct(F.array(item(1), item(2)).alias("profiles"), F.array(item(2)).alias("characters"), F.array(F.struct(F.lit("n").alias("name"))).alias("relatedProfiles"), F.lit("more").alias("hint"), F.array(F.struct(F.col("p_brand").alias("keyword"))).alias("suggestions"), F.col("p_size").cast("string").alias("next_cursor")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", payload.alias("payload"))


@query("""
SELECT p_partkey AS from_pid, p_partkey + n AS to_pid, relation, 'related:' || relation AS source FROM part, (VALUES (1, 'profiles'), (2, 'profiles'), (2, 'characters')) AS v(n, relation)
""")
def related_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.related_edges(_related(spark, sf_dir), seed_col="p_partkey", json_col="payload")


@query("SELECT p_partkey, 'more,' || p_brand AS hints, CAST(p_size AS BIGINT) AS cursor FROM part")
def hints_and_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("payload")
    return _related(spark, sf_dir).select("p_partkey", F.array_join(profiles.hints(j, F.lit("q")), ",").alias("hints"), profiles.next_cursor(j).alias("cursor"))


@query("""
WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<a href="/profile/' || page_id || '">x</a>' ELSE '' END || ' sub_cat_id: ' || page_id || ' ' AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/profile/' || page_id ELSE '/profile?sub_cat_id=' || page_id END AS link FROM h
""")
def profile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    html = F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="/profile/'), page, F.lit('">x</a>'))).otherwise(""), F.lit(" sub_cat_id: "), page, F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(profiles.profile_links(html)).alias("link"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000, l_orderkey + 2000000 FROM lineitem),
r AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.node WHERE r.level < 3) SELECT node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY node
""")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_partkey").alias("from_pid"), (F.col("l_suppkey") + 1_000_000).alias("to_pid")).unionByName(lines.select((F.col("l_suppkey") + 1_000_000).alias("from_pid"), (F.col("l_orderkey") + 2_000_000).alias("to_pid")))
    return profiles.frontier(edges, spark.range(1, 2), 3)


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'character' ELSE 'other' END AS class FROM events WHERE event_type IN ('click', 'view', 'error') AND user_id % 2 = 1
""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.category(F.col("event_type"), ((("click", "view"), "character"),), "other")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error") & (F.col("user_id") % 2 == 1)).select("event_id", kind.alias("class"))


@query("""
SELECT known_id, o.o_orderkey, o.o_totalprice FROM (SELECT DISTINCT o_custkey::VARCHAR AS known_id, o_orderkey FROM orders UNION SELECT DISTINCT o_orderkey::VARCHAR, o_orderkey FROM orders) k JOIN orders o USING (o_orderkey) WHERE known_id IN ('1', '7', '100')
""")
def lookup_any_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marigold.operators import store

    orders = table(spark, sf_dir, "orders")
    known = store.identifiers(orders, "o_orderkey", ["o_orderkey", "o_custkey"])
    return known.where(F.col("known_id").isin("1", "7", "100")).join(orders, "o_orderkey").select("known_id", "o_orderkey", "o_totalprice")


@query("""
SELECT event_id, '[' || strftime(make_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '] ch:' || user_id || ' msg:' || event_id || ' author:' || substr(sha256('s:' || user_id), 1, 8) || ' score:' || printf('%.3f', (value + 0.00001::DOUBLE) / 7) AS line FROM events
""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marigold.functions import hashing

    created = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    line = text.context_line(created, F.col("user_id"), F.col("event_id"), hashing.salted_user_hash("s", F.col("user_id")), (F.col("value") + 0.00001) / 7)
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, q.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS ab,
list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS aa, list_sum(list_transform(q.v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS bb FROM embeddings, q),
s AS (SELECT vec_id, label, round(ab / (sqrt(aa) * sqrt(bb) + 1e-9::DOUBLE), 6) AS score FROM d ORDER BY score DESC, vec_id LIMIT 4)
SELECT '[' || string_agg('{"vec_id":' || vec_id || ',"label":' || label || ',"score":' || score || '}', ',' ORDER BY score DESC, vec_id) || ']' AS context FROM s
""")
def result_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return profiles.result_context(search.cosine_topk(v, v.where("vec_id = 0").first()["embedding"], 4).select("vec_id", "label", "score"))
