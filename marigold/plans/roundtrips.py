"""Sources and sinks on the driver's tables: what is written is read back and compared with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marigold.functions import geometry, hashing, text, vectors
from marigold.operators import ml, profiles, relational, search, stats
from marigold.lineage import scratch, written
from marigold.registry import query, table
from marigold.sources import readers, sinks
from marigold.streaming import messages


@query("SELECT c_custkey, upper(c_name) AS name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def parquet_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, then replaced by a plan that reads the old one."""
    path = scratch(spark, "customers.parquet")
    sinks.replace_parquet(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    sinks.replace_parquet(spark.read.parquet(path).where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("name"), "c_acctbal"), path)
    return readers.parquet_or_empty(spark, path, "c_custkey long, name string, c_acctbal double")


@query("SELECT (SELECT count(*) FROM customer) AS archived, 0::BIGINT AS live, 0::BIGINT AS missing, CAST(25 AS BIGINT) AS readable")
def parquet_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the archive, of the table that a rotation empties, of a table that is missing, and of the readable files beside a broken one."""
    path, archive, broken = (scratch(spark, f"{n}.parquet") for n in ("live", "archive", "broken"))
    rows, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    sinks.replace_parquet(rows, path)
    sinks.rotate(spark, path, archive, rows.schema)
    nations.write.parquet(broken)
    spark.createDataFrame([("no Parquet",)], "value string").coalesce(1).write.mode("append").text(broken)
    held = {"archived": spark.read.parquet(archive), "live": spark.read.parquet(path), "missing": readers.parquet_or_empty(spark, scratch(spark, "none"), rows.schema)}
    held["readable"] = readers.parquet_or_empty(spark, broken, nations.schema, skip_corrupt=True)
    counted = relational.table_counts(held)
    return counted.agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in held))


@query("SELECT doc_id, md5(text) AS text_md5, n_chars FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with quotes and line ends, by CSV and back."""
    path = scratch(spark, "documents.csv")
    sinks.export(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), path, "csv")
    back = readers.by_suffix(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), F.col("n_chars").cast("long").alias("n_chars"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vectors_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by JSON, then as JSON text in CSV, and back by column detection."""
    path, flat = scratch(spark, "vectors.json"), scratch(spark, "vectors.csv")
    sinks.export(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vector")), path, "json")
    sinks.export(readers.by_suffix(spark, path, "cid long, vector array<double>"), flat, "csv")
    back = readers.vectors(readers.by_suffix(spark, flat))
    return back.select(F.col("cid").cast("long").alias("vec_id"), F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def orc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pages.orc")
    sinks.export(table(spark, sf_dir, "pages"), path, "orc")
    return readers.by_suffix(spark, path).select("page_id", "url", F.md5("html").alias("html_md5"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%' ORDER BY c_custkey LIMIT 20")
def csv_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in a CSV file, its hits as CSV with a header, read back."""
    source, hits = scratch(spark, "customers.csv"), scratch(spark, "hits.csv")
    sinks.export(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), source, "csv")
    rows = readers.by_suffix(spark, source, "c_custkey long, c_name string, c_mktsegment string")
    sinks.export(search.any_column_contains(rows, "7", ["c_name", "c_mktsegment"]).orderBy("c_custkey").limit(20), hits, "csv")
    return readers.by_suffix(spark, hits, "c_custkey long, c_name string, c_mktsegment string")


@query("SELECT 'a,b' AS header, 0::BIGINT AS hits")
def csv_without_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of no rows has its header."""
    path = scratch(spark, "none.csv")
    sinks.export(table(spark, sf_dir, "region").where("r_regionkey < 0").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b")), path, "csv")
    return spark.read.text(path).agg(F.max("value").alias("header")).join(readers.by_suffix(spark, path).agg(F.count("*").alias("hits")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'named' END AS name FROM customer")
def csv_name_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "unnamed.csv")
    own = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit(" ")).alias("name"))
    sinks.export(own, path, "csv")
    names = own.select("c_custkey", F.lit("named").alias("name"))
    return readers.with_names(readers.by_suffix(spark, path, "c_custkey long, name string"), names, "c_custkey")


@query("SELECT n_name || '.md' AS file, n_name || chr(10) || n_regionkey AS text FROM nation WHERE n_nationkey % 2 = 0")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several folders, one text each; other kinds of files are left out."""
    root = scratch(spark, "notes")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(25).collect():
        name = f"{root}/{r.n_regionkey}/{r.n_name}.{'md' if r.n_nationkey % 2 == 0 else 'bin'}"
        out = target.create(fs.Path(name))
        out.write(bytearray(f"{r.n_name}\n{r.n_regionkey}".encode()))
        out.close()
    found = readers.documents(spark, root)
    return found.select(F.try_url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), "text")


@query("SELECT 'load' AS event, 25::BIGINT AS n, count(*) FILTER (WHERE n_nationkey >= 0) AS total FROM nation UNION ALL SELECT 'stop', 0, 0")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two audit records by event; every record has a UTC time."""
    path, nations = scratch(spark, "audit.jsonl"), table(spark, sf_dir, "nation")
    held = readers.as_view(nations, "audited_nations")
    sinks.audit(spark, path, "load", n=held, total=spark.table("audited_nations").where("n_nationkey >= 0").count())
    sinks.audit(spark, path, "stop", n=0, total=0)
    return readers.by_suffix(spark, path).where(F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT.*Z$")).select("event", "n", "total")


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS user FROM events")
def flattened_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return sinks.all_text(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")), "payload", ["kind", "user"])


@query("SELECT c_custkey, c_name AS name, CAST(2 AS INTEGER) AS kept FROM customer")
def provenance_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("name"), F.col("c_name"), F.lit("_source"), F.lit("crawl"), F.lit("kind"), F.lit("x"), F.lit("_seed_id"), F.lit("7"))
    stripped = table(spark, sf_dir, "customer").select("c_custkey", text.without_provenance(fields).alias("m"))
    return stripped.select("c_custkey", F.try_element_at("m", F.lit("name")).alias("name"), F.size("m").alias("kept"))


@query("SELECT c_custkey, c_nationkey % 5 IN (0, 3) OR c_nationkey % 4 IN (0, 3) AS by_role, c_custkey % 2 = 0 AS by_flag FROM customer")
def admin_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access by roles where some are configured, and by the manage flag where none are."""
    users = stats.require_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"])
    roles, manages = F.array(F.col("c_nationkey") % 5, F.col("c_nationkey") % 4), F.col("c_custkey") % 2 == 0
    return users.select("c_custkey", profiles.has_access(roles, [0, 3], manages).alias("by_role"), profiles.has_access(roles, [], manages).alias("by_flag"))


@query("""
SELECT CAST(max(len(embedding)) AS INTEGER) AS dimensions, round(avg(len(list_filter(embedding, lambda x: x <> 0))), 6) AS mean_nonzero,
round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS mean_norm FROM embeddings
""")
def embedding_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.embedding_pool(table(spark, sf_dir, "embeddings"))


_HEX = "list_reduce(list_concat([0::BIGINT], list_transform(string_split(sha256(t), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT)), lambda r, d: (r * 16 + d) % 384)"


@query(f"""
WITH t AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda t: t <> '')) AS t FROM part),
c AS (SELECT p_partkey, CAST({_HEX} AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT p_partkey, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 6) AS weight FROM c
""")
def hash_embed_384(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash embeddings in as many dimensions as another index has."""
    return search.hash_embedding_buckets(table(spark, sf_dir, "part"), id_col="p_partkey", text_col="p_name", dimensions=384).withColumn("weight", F.round("weight", 6))


@query(f"""
WITH t AS (SELECT p_partkey, regexp_split_to_array(lower(p_name), '\\s+')[1] AS t FROM part) SELECT p_partkey, CAST({_HEX} AS INTEGER) AS bucket FROM t
""")
def hash_bucket_384(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same modulus as a column expression, of each name's first word."""
    return table(spark, sf_dir, "part").select("p_partkey", hashing.sha_bucket(text.tokens(F.col("p_name"))[0], 384).alias("bucket"))


@query("""
SELECT label, CAST(least(12, greatest(3, floor(sqrt(n) + 0.5))) AS INTEGER) AS k FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
""")
def suggested_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.suggested_k(table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "n").select("label", "k")


@query("""
WITH c AS (SELECT label, array_agg(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, centre), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(centre, lambda x: x * x))) + 1e-9) AS sim FROM embeddings JOIN c USING (label)),
n AS (SELECT vec_id, label, greatest(2.0::DOUBLE, 12 * (1 - greatest(0, least(1, sim)))) AS reach, ('0x' || substr(md5('7:lat:' || vec_id), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 AS a, ('0x' || substr(md5('7:lon:' || vec_id), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 AS b FROM s)
SELECT vec_id, round(10.0::DOUBLE * label + reach * a, 5) AS lat, round(-5.0::DOUBLE * label + reach * b, 5) AS lon FROM n
""")
def jittered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors around the places of their labels, by similarity to the label's mean vector."""
    v = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    centres = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # one component each
    near = vectors.cosine(F.col("embedding"), F.col("centre"))
    placed = v.join(centres, "label").select("vec_id", geometry.jittered(10.0 * F.col("label"), -5.0 * F.col("label"), near, F.col("vec_id"), 7).alias("p"))
    return placed.select("vec_id", F.round("p.lat", 5).alias("lat"), F.round("p.lon", 5).alias("lon"))


@query("SELECT n_nationkey, 'a|' || n_name || '|c' AS items FROM nation")
def token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.list_items(F.concat(F.lit("a, "), "n_name", F.lit(" ,c")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(parts, "|").alias("items"))


@query("SELECT DISTINCT conv_id AS channel_id, turn AS message_id FROM conversations WHERE trim(text) <> ''")
def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of a file stream appended to a table, each message once."""
    source, out, state = (scratch(spark, n) for n in ("chat", "ingested", "state"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel_id"), F.col("turn").alias("message_id"), F.col("text").alias("content"))
    turns.unionByName(turns.where("channel_id % 3 = 0")).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(source)
    messages.ingest(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select("channel_id", "message_id")


_LISTED = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, coalesce(n, 0) AS rating_count, u AS updated_at FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, max(o_orderdate) AS u FROM orders GROUP BY 1) ON k = c_custkey
"""
_ORDERS = {"name": "name, id", "name-desc": "name DESC, id", "category": "category, name, id", "rating_count": "rating_count DESC, name, id", "updated": "updated_at DESC NULLS LAST, id"}


@query(" UNION ALL ".join(f"(SELECT '{mode}' AS mode, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, id FROM ({_LISTED}) QUALIFY place <= 15)" for mode, order in _ORDERS.items()))
def entity_list_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entities of each of the five sort modes."""
    orders = table(spark, sf_dir, "orders")
    updated = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("updated_at"))
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category")).join(updated, "id", "left")
    ratings, out = orders.select(F.col("o_custkey").alias("entity_id"), (F.col("o_totalprice") / 1000).alias("confidence")), None
    for mode, keys in relational.SORTS.items():
        first = relational.entity_list(entities, ratings, sort=mode, limit=15)
        place = F.row_number().over(Window.orderBy(*(F.col(c).asc() if up else F.col(c).desc() for c, up in keys), "id"))  # of 15 rows
        listed = first.select(F.lit(mode).alias("mode"), place.alias("place"), "id")
        out = listed if out is None else out.unionByName(listed)
    return out


@query("""
WITH k AS (SELECT user_id AS u, event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY u) AS m FROM k QUALIFY m > 1),
o AS (SELECT avg(p) AS observed, count(*) AS units FROM (SELECT u, (sum(n * n) - any_value(m)) / (any_value(m) * (any_value(m) - 1))::DOUBLE AS p FROM s GROUP BY u)),
e AS (SELECT sum(n * n) / (sum(n) * sum(n))::DOUBLE AS expected FROM (SELECT v, sum(n) AS n FROM s GROUP BY v))
SELECT round((observed - expected) / (1 - expected), 6) AS kappa, units FROM o, e
""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fleiss_kappa(table(spark, sf_dir, "events"), unit="user_id", value="event_type")


@query("""
WITH r AS (SELECT user_id AS u, value AS x FROM events WHERE value IS NOT NULL), p AS (SELECT u, count(*) AS n, avg(x) AS m FROM r GROUP BY u HAVING count(*) > 1), g AS (SELECT avg(x) AS g, count(*) AS t FROM r JOIN p USING (u)),
b AS (SELECT sum(n * (m - g) * (m - g)) / (count(*) - 1) AS msb, count(*) AS units, sum(n * n) AS squares FROM p, g), w AS (SELECT sum((x - m) * (x - m)) AS ss FROM r JOIN p USING (u)),
s AS (SELECT msb, ss / (t - units) AS msw, (t - squares / t::DOUBLE) / (units - 1) AS k, units FROM b, w, g)
SELECT round((msb - msw) / (msb + (k - 1) * msw), 6) AS icc, units FROM s
""")
def intraclass_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.intraclass_correlation(table(spark, sf_dir, "events"), unit="user_id", value="value")


@query("SELECT a.c_custkey, b.p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC) AS n FROM customer) a JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part) b USING (n)")
def rows_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last customers by number beside the first parts."""
    backwards = table(spark, sf_dir, "customer").select("c_custkey", (-F.regexp_extract("c_name", r"(\d+)$", 1).cast("long")).alias("o"))
    return relational.zipped(backwards, table(spark, sf_dir, "part").select("p_partkey"), ["o"], ["p_partkey"]).select("c_custkey", "p_partkey")


@query("SELECT count(*) AS seen, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large FROM events")
def process_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that fill while a table is written."""
    counted, observed = stats.counters(table(spark, sf_dir, "events"), "events", seen=F.lit(True), clicks=F.col("event_type") == "click", large=F.col("value") > 50)
    written(counted.select("event_id"), "counted")
    return spark.createDataFrame([tuple(observed.get[n] for n in ("seen", "clicks", "large"))], "seen long, clicks long, large long")


@query()
def pca_new_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection fitted on even ids and applied to the others; tests hold it against numpy."""
    v = table(spark, sf_dir, "embeddings")
    _, fitted = ml.fit_pca(v.where("vec_id % 2 = 0"), 3)
    return v.where("vec_id % 2 = 1").select("vec_id", fitted.of(F.col("embedding")).alias("p")).select("vec_id", *(F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(3)))


@query()
def manifest_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return profiles.manifest_with_variance(docs, table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), key="id", vector_col="embedding")
