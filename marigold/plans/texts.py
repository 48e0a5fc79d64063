"""Text, JSON, URL and identifier queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import geometry, hashing, text
from marigold.operators import stats
from marigold.registry import query, table

# Ordered rules from terms to categories.
CATEGORIES = ((("anime", "manga"), "Anime"), (("movie", "film"), "Movies"), (("tv", "series", "show"), "TV Shows"), (("book", "novel", "literature"), "Books"), (("game", "gaming"), "Games"), (("comic", "marvel", "dc"), "Comics"))
PART_RULES = ((("brass", "steel"), "metal"), (("promo",), "promo"), (("small", "economy"), "basic"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'promo') THEN 'promo'
WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'economy') THEN 'basic' ELSE 'Other' END AS category FROM part
""")
def category_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.category(F.col("p_type"), PART_RULES, "Other").alias("category"))


@query("SELECT event_id, round(least(0.95::DOUBLE, greatest(0.3::DOUBLE, value / 100.0::DOUBLE)), 6) AS confidence FROM events")
def confidence_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(text.vote_confidence(F.col("value")), 6).alias("confidence"))


@query("""
SELECT CASE WHEN contains(event_type, 'click') THEN 'character' WHEN contains(event_type, 'view') OR contains(event_type, 'purchase') THEN 'person' ELSE 'other' END AS class, count(*) AS n
FROM events GROUP BY 1
""")
def class_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ((("click",), "character"), (("view", "purchase"), "person"))
    return table(spark, sf_dir, "events").groupBy(text.category(F.col("event_type"), rules, "other").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.int_like(F.get_json_object("props", "$.k")).alias("k")).where("k IS NOT NULL")


@query("""
SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL
""")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field discovery: which keys payloads have, by type."""
    return table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM l GROUP BY page_id
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("href"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"))


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page,
CAST(CASE WHEN regexp_matches(url, '/[0-9]+(\\?|$)') THEN regexp_extract(url, '/([0-9]+)(\\?|$)', 1) END AS BIGINT) AS path_id FROM pages
""")
def url_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, query parameter and the number that ends the path."""
    url = F.col("url")
    number = F.nullif(F.regexp_extract(url, r"/([0-9]+)(\?|$)", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"), number.cast("long").alias("path_id"))


@query("""
SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(text, '\\b(your|you''re|you are)\\s+(an?\\s+)?(ILE|LII|ESE|SEI|SLE|LSI|EIE|IEI|LIE|ILI|SEE|ESI|IEE|EII|LSE|SLI)\\b', 'i') OR regexp_matches(text, '\\bwhat\\s+type\\s+am\\s+i\\b', 'i') THEN 'direct_type_request' END,
CASE WHEN regexp_matches(text, '\\bdiagnos(e|is|tic)\\b', 'i') THEN 'prohibited_topic' END], lambda x: x IS NOT NULL) AS reasons FROM conversations
""")
def guardrail_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.guardrail_reasons(F.col("text")).alias("reasons"))


_CID = """'b' || array_to_string(list_transform(range(58), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', CAST(('0b' || substr(bits || '00', CAST(i * 5 + 1 AS BIGINT), 5))::INTEGER + 1 AS BIGINT), 1)), '')"""


@query("""
WITH b AS (SELECT doc_id, array_to_string(list_transform(range(1, 73), lambda i: CASE substr('01551220' || sha256(text), CAST(i AS BIGINT), 1)
 WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
 WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') || '00' AS bits FROM documents),
g AS (SELECT doc_id, i, substr(bits, CAST(i * 5 + 1 AS BIGINT), 5) AS five FROM b, range(58) r(i)),
v AS (SELECT doc_id, i, (ascii(substr(five,1,1))-48)*16 + (ascii(substr(five,2,1))-48)*8 + (ascii(substr(five,3,1))-48)*4 + (ascii(substr(five,4,1))-48)*2 + (ascii(substr(five,5,1))-48) AS n FROM g)
SELECT doc_id, 'b' || string_agg(substr('abcdefghijklmnopqrstuvwxyz234567', CAST(n + 1 AS BIGINT), 1), '' ORDER BY i) AS cid FROM v GROUP BY doc_id
""")
def cid_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", hashing.cid_v1(F.col("text")).alias("cid"))


@query("""
SELECT doc_id, h, count(*) AS n FROM (SELECT doc_id, substr(sha256('salt:' || t), 1, 16) AS h FROM
(SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')[1:100]) AS t FROM documents)) GROUP BY ALL
""")
def salted_hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.slice(text.tokens(F.col("text")), 1, 100)).alias("t"))
    return capped.groupBy("doc_id", hashing.salted_token_hash("salt", F.col("t")).alias("h")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, substr(sha256('salt:' || c_custkey::VARCHAR), 1, 32) AS user_hash FROM customer")
def salted_user_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.salted_user_hash("salt", F.col("c_custkey")).alias("user_hash"))


@query("""
WITH m AS (SELECT max(ts) AS hi FROM events) SELECT event_id FROM events, m WHERE ts BETWEEN hi - INTERVAL 129600 SECOND AND hi
""")
def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last day and a half ("1d12h") before the newest one."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("hi")).withColumn("lo", F.col("hi") - F.make_dt_interval(secs=text.duration_seconds(F.lit("1d12h")).cast("decimal(18,6)")))
    return events.join(F.broadcast(newest), F.col("ts").between(F.col("lo"), F.col("hi"))).select("event_id")


@query("""
SELECT doc_id, round(((f % 2000) / 1000.0::DOUBLE) - 1, 6) AS x FROM (SELECT doc_id,
list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(doc_id::VARCHAR || ':x', ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS f FROM documents)
""")
def hash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(hashing.hash_coordinate(key), 6).alias("x"))


def _codes() -> list[str]:
    return list(geometry.CODES)


def _type_rows() -> str:
    return ", ".join(f"({i}, '{c}', '{geometry.CODES[c]}')" for i, c in enumerate(_codes()))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*(F.lit(c) for c in _codes())), (F.col("vec_id") % 16).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", geometry.normalized_type(F.lower(code)).alias("mbti"))


@query(f"SELECT vec_id, mbti FROM embeddings JOIN (VALUES {_type_rows()}) AS t(i, code, mbti) ON vec_id % 16 = i")
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir)


@query(f"""
WITH t AS (SELECT vec_id, mbti FROM embeddings JOIN (VALUES {_type_rows()}) AS t(i, code, mbti) ON vec_id % 16 = i),
v AS (SELECT vec_id, CASE WHEN mbti[1] = 'E' THEN 0.5::DOUBLE ELSE -0.5 END AS a, CASE WHEN mbti[2] = 'N' THEN 0.5::DOUBLE ELSE -0.5 END AS b, CASE WHEN mbti[3] = 'F' THEN 0.5::DOUBLE ELSE -0.5 END AS c, CASE WHEN mbti[4] = 'P' THEN 0.5::DOUBLE ELSE -0.5 END AS d FROM t),
h AS (SELECT vec_id, 2 * (a*c + b*d) AS x, 2 * (b*c - a*d) AS y, (a*a + b*b) - (c*c + d*d) AS z FROM v),
n AS (SELECT vec_id, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, CASE WHEN x*x+y*y+z*z = 0 THEN 1 ELSE sqrt(x*x+y*y+z*z) END AS l FROM h))
SELECT vec_id, round(degrees(asin(greatest(-1, least(1, y)))), 6) + 0.0::DOUBLE AS lat, round(degrees(atan2(z, x)), 6) + 0.0::DOUBLE AS lon FROM n
""")
def hopf_latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _typed(spark, sf_dir).select("vec_id", geometry.lat_lon(geometry.hopf(geometry.type_vector(F.col("mbti")))).alias("p"))
    return placed.select("vec_id", (F.round("p.lat", 6) + 0.0).alias("lat"), (F.round("p.lon", 6) + 0.0).alias("lon"))


@query("""
WITH n AS (SELECT count(*) AS n FROM nation), p AS (SELECT n_nationkey, n_nationkey * (2.0::DOUBLE / n) - 1 + 1.0::DOUBLE / n AS y, n_nationkey * (pi() * (3 - sqrt(5))) AS phi FROM nation, n)
SELECT n_nationkey, round(degrees(asin(y)), 6) AS lat, round(degrees(atan2(sin(phi) * sqrt(1 - y*y), cos(phi) * sqrt(1 - y*y))), 6) AS lon FROM p
""")
def fibonacci_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    n = nations.agg(F.count("*").alias("n"))
    placed = nations.join(F.broadcast(n)).select("n_nationkey", geometry.fibonacci_point(F.col("n_nationkey"), F.col("n")).alias("p"))
    return placed.select("n_nationkey", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("""
SELECT doc_id, CAST(len(list_filter(w, lambda t: t IN ('the', 'und', 'de', 'el'))) AS BIGINT) AS hits, CAST(len(w) AS BIGINT) AS tokens,
round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda t: t IN ('the', 'und', 'de', 'el'))) * 100.0::DOUBLE / len(w) ELSE 0 END, 6) AS per_100
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents)
""")
def lexicon_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lexicon_rates(table(spark, sf_dir, "documents"), ["the", "und", "de", "el"], id_col="doc_id", text_col="text")


@query("""
SELECT c_custkey, array_to_string(list_transform(string_split(replace(lower(c_name), '#', ' '), ' '), lambda w: CASE WHEN length(w) <= 4 AND w = upper(w) THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS shown FROM customer
""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.translate("c_name", "#", " "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.display_name(name).alias("shown"))
