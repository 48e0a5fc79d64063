"""Entity, rating and set queries on the driver's tables: customers are entities and raters, orders their judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.operators import relational, stats, store
from marigold.registry import query, table


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), (F.col("o_totalprice") / 1000).alias("confidence"))


def _rounded(df: DataFrame) -> DataFrame:
    """Means to 6 places; the offset keeps means that lie between two of them on one side in any engine."""
    return df.withColumn("average_confidence", F.round(F.col("average_confidence") + 1e-8, 6))


_LIST = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, coalesce(n, 0) AS rating_count, m AS avg_confidence
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice / 1000), 6) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey
"""


@query(f"{_LIST} ORDER BY rating_count DESC, name, id LIMIT 50 OFFSET 10")
def entity_list_sorted_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.entity_list(_entities(spark, sf_dir), _ratings(spark, sf_dir), sort="rating_count", limit=50, offset=10)


@query(f"{_LIST} WHERE c_name ILIKE '%00%' OR c_mktsegment ILIKE '%00%' ORDER BY name DESC, id LIMIT 25")
def entity_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.entity_list(_entities(spark, sf_dir), _ratings(spark, sf_dir), search="00", sort="name-desc", limit=25)


@query(f"{_LIST} WHERE c_mktsegment = 'BUILDING' ORDER BY category, name, id LIMIT 40")
def entity_list_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.entity_list(_entities(spark, sf_dir), _ratings(spark, sf_dir), category="BUILDING", sort="category", limit=40)


@query("""
SELECT n_nationkey AS entity_id, n_name AS entity_name, c_mktsegment AS system, o_orderpriority AS type_code, count(o_orderkey) AS total_judgments,
round(avg(o_totalprice) + 1e-8, 6) AS average_confidence, max(o_orderdate) AS last_typed
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
""")
def typing_summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_name"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("judgment_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("type_id"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("entity_id"), F.col("c_mktsegment").alias("system"))
    judgments = customers.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey", "c_custkey")
    types = orders.select("type_id").distinct().withColumn("type_code", F.col("type_id"))
    return _rounded(relational.typing_summary(entities, judgments, types))


@query("""
SELECT c_custkey AS rater_id, c_name AS username, count(o_orderkey) AS total_judgments, round(avg(o_totalprice) + 1e-8, 6) AS average_confidence, count(DISTINCT o_orderstatus) AS entities_typed,
count(DISTINCT o_orderpriority) AS sessions_participated, min(o_orderdate) AS first_judgment, max(o_orderdate) AS last_judgment
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY ALL
""")
def rater_summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rater_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 0).alias("is_active"))
    judgments = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("rater_id"), F.col("o_orderkey").alias("judgment_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderstatus").alias("entity_id"), F.col("o_orderpriority").alias("session_id"), F.col("o_orderdate").alias("created_at")
    )
    return _rounded(relational.rater_summary(users, judgments))


@query("""
SELECT user_id, event_id, event_type, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3
""")
def latest_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(table(spark, sf_dir, "events"), "user_id", "ts", 3, "event_id").select("user_id", "event_id", "event_type", "rank")


@query("SELECT event_id, user_id, c_name AS user_name FROM events LEFT JOIN customer ON c_custkey = user_id")
def enrich_user_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return table(spark, sf_dir, "events").join(names, "user_id", "left").select("event_id", "user_id", "user_name")


@query("""
SELECT n_nationkey AS entity_id, coalesce(list_sort(list(DISTINCT c_mktsegment) FILTER (WHERE c_mktsegment IS NOT NULL)), []) AS types FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"))
    links = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity_id"), F.col("c_mktsegment").alias("type_id"))
    return relational.with_types(entities, links, links.select("type_id").distinct().withColumn("type_code", F.col("type_id")))


@query("""
SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events
""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.table_counts({n: table(spark, sf_dir, n) for n in ("documents", "embeddings", "orders", "events")})


@query("""
SELECT value, n, CAST(floor(n * 100 / total) AS BIGINT) AS percent FROM (SELECT source AS value, count(*) AS n, sum(count(*)) OVER () AS total FROM documents WHERE source <> '' GROUP BY 1) ORDER BY n DESC, value LIMIT 10
""")
def value_counts_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(table(spark, sf_dir, "documents"), "source")


@query("SELECT 'lang' AS facet, lang AS value FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("lang", "source")))).alias("f")
    return table(spark, sf_dir, "documents").select(facets).select("f.*").where("value IS NOT NULL").distinct()


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 5
""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.balanced_sample(table(spark, sf_dir, "documents"), "source", 5, "doc_id").select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return relational.missing_references(table(spark, sf_dir, "lineitem"), "l_suppkey", suppliers, "s_suppkey").select("l_orderkey", "l_linenumber")


@query("""
SELECT 'l_discount' AS "column", count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05::DOUBLE) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 40) FROM lineitem
""")
def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.out_of_range(table(spark, sf_dir, "lineitem"), {"l_discount": (0, 0.05), "l_quantity": (1, 40)})


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("""
SELECT d.doc_id, d.lang, l.quality, true AS has_label FROM documents d JOIN labels l USING (doc_id)
""")
def combined_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", F.lit(True).alias("has_label"))


@query("SELECT doc_id, lang, (doc_id IN (SELECT doc_id FROM labels)) AS has_label FROM documents")
def presence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has_label", F.lit(True))
    return table(spark, sf_dir, "documents").join(have, "doc_id", "left").select("doc_id", "lang", F.coalesce("has_label", F.lit(False)).alias("has_label"))


@query("""
SELECT DISTINCT known_id, o_orderkey FROM (SELECT o_orderkey::VARCHAR AS known_id, o_orderkey FROM orders UNION ALL SELECT o_custkey::VARCHAR, o_orderkey FROM orders)
""")
def idmap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.identifiers(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey"])


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL INTERSECT SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id").intersect(labels.select("doc_id")).subtract(labels.where("toxic = 1").select("doc_id"))
