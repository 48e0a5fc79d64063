"""Store queries on the driver's tables: upserts, deletes, tags, history and message ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import text
from marigold.operators import store
from marigold.registry import query, table
from marigold.sources import readers
from marigold.streaming import messages


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_first(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id")


_UPSERT = """
WITH b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0),
u AS (SELECT coalesce(b.k, i.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.v ELSE b.v END AS v, CASE WHEN b.k IS NULL THEN 'new' WHEN i.k IS NULL OR b.v IS NOT DISTINCT FROM i.v THEN 'same' ELSE 'updated' END AS status FROM b FULL JOIN i ON b.k = i.k)
"""


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    batch = rows.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 2 == 0, "CHANGED").otherwise(F.col("v")))
    return store.upsert(rows.where("k % 3 <> 0"), batch, ["k"], "v")


@query(_UPSERT + "SELECT * FROM u")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)


@query(_UPSERT + "SELECT count(*) FILTER (WHERE status = 'new') AS \"new\", count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'same') AS same FROM u")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_counts(_applied(spark, sf_dir))


_EDGES = "SELECT DISTINCT l_partkey AS from_pid, l_suppkey AS to_pid, l_returnflag AS relation FROM lineitem"


@query(f"SELECT from_pid, to_pid, relation FROM ({_EDGES})")
def edges_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_pid"), F.col("l_suppkey").alias("to_pid"), F.col("l_returnflag").alias("relation"))
    base = edges.where("relation = 'N'").distinct()
    return store.append_edges(base, edges)


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (1, 5, 50)")
def purge_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purge(table(spark, sf_dir, "events"), "event_id", [1, 5, 50]).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7 AND event_id IN (SELECT event_id FROM events WHERE value > 10)")
def message_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.where((F.col("event_type") == "click") & (F.col("user_id") == 7)).join(events.where("value > 10").select("event_id"), "event_id", "left_semi").select("event_id")


@query("""
SELECT c_custkey, field, old_value, new_value FROM (SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, lower(c_mktsegment) AS new_value FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'c_name', c_name, c_name || '!' FROM customer WHERE c_custkey % 3 = 0)
""")
def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    even, third = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0
    after = before.withColumn("c_mktsegment", F.when(even, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))).withColumn("c_name", F.when(third, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return store.change_history(before, after, "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT count(*) AS n, count(DISTINCT sha256(text)) AS payloads FROM documents WHERE text IS NOT NULL")
def compact_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("text").alias("payload"))
    return raw.agg(F.count("*").alias("n")).join(store.compact(raw).agg(F.count("*").alias("payloads")))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'seed' END AS search_keyword FROM documents")
def tag_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tag(table(spark, sf_dir, "documents"), F.col("source") == "src1", "search_keyword", "seed").select("doc_id", "search_keyword")


@query("SELECT page_id, 'crawl' AS _source, 'kw' AS _keyword FROM pages")
def provenance_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stamped(table(spark, sf_dir, "pages").select("page_id"), source="crawl", keyword="kw")


@query("""
SELECT n_nationkey, q, e FROM (SELECT n_nationkey, n_name AS q, false AS e FROM nation UNION ALL SELECT n_nationkey, n_name || ' characters', true FROM nation UNION ALL SELECT n_nationkey, n_name || ' cast', true FROM nation)
""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = F.array(F.struct(F.col("n_name").alias("q"), F.lit(False).alias("e")), *(F.struct(F.concat("n_name", F.lit(f" {t}")).alias("q"), F.lit(True).alias("e")) for t in ("characters", "cast")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(expanded).alias("x")).select("n_nationkey", "x.q", "x.e")


@query("""
SELECT url, min(kw) AS keyword FROM (SELECT regexp_replace(url, '\\?.*$', '') AS url, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS kw FROM pages) GROUP BY url
""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs; a keyword that is not null is preferred."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"\?.*$", "").alias("url"), F.nullif(F.regexp_extract("url", "[?&]ref=([^&#]*)", 1), F.lit("")).alias("kw"))
    return pages.groupBy("url").agg(F.min("kw").alias("keyword"))


@query("SELECT conv_id AS channel_id, turn AS message_id, any_value(role) AS role FROM conversations WHERE trim(text) <> '' AND NOT (turn = 0 AND conv_id % 2 = 0) GROUP BY ALL")
def message_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel_id"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"))
    return messages.new_messages(turns, turns.where("message_id = 0 AND channel_id % 2 = 0")).drop("content")


@query("SELECT vec_id::VARCHAR AS cid, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column detection: the id and vector columns are found by name and type."""
    raw = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "profile_id")
    return readers.vectors(raw).select("cid", F.size("vector").alias("n"), F.round(F.col("vector")[0], 6).alias("first"))


@query("SELECT doc_id::VARCHAR AS cid, source AS name, lang AS mbti, source || ' ' || lang AS text FROM documents")
def profile_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("profile_id"), F.col("source").alias("title"), F.col("lang").alias("mbti_type"))
    return readers.profiles(raw).select("cid", "name", "mbti", "text")


@query("SELECT event_id, 'type ' || event_type AS name, CAST(NULL AS VARCHAR) AS mbti, CAST(user_id AS VARCHAR) AS socionics FROM events")
def normalize_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON payloads with a synonym for the name and a nested attribute."""
    payload = F.to_json(F.struct(F.concat(F.lit("type "), F.col("event_type")).alias("title"), F.struct(F.col("user_id").cast("string").alias("socionics_type")).alias("attributes")))
    rows = table(spark, sf_dir, "events").select("event_id", text.normalized_profile(payload).alias("p"))
    return rows.select("event_id", "p.name", "p.mbti", "p.socionics")
