"""Distributions, divergences, folds and reports on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marigold.functions import geometry, text
from marigold.lineage import scratch
from marigold.operators import search, stats
from marigold.registry import query, table
from marigold.streaming import limiter, messages


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as survey answers: type, question and a value from 0 to 4."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("type_label"), (F.col("user_id") % 10).alias("question_id"), (F.floor("value") % 5).alias("answer_value"))


_DIVERGENCE = """
WITH a AS (SELECT event_type AS t, user_id % 10 AS q, CAST(floor(value) AS BIGINT) % 5 AS v FROM events WHERE value IS NOT NULL), c AS (SELECT t, q, v, count(*) AS n FROM a GROUP BY ALL),
s AS (SELECT DISTINCT q, v FROM c), g AS (SELECT t.t, s.q, s.v FROM (SELECT DISTINCT t, q FROM a) t JOIN s USING (q)),
f AS (SELECT g.t, g.q, g.v, coalesce(n, 0) + 1e-6::DOUBLE AS c FROM g LEFT JOIN c USING (t, q, v)), p AS (SELECT t, q, v, c / sum(c) OVER (PARTITION BY t, q) AS p FROM f),
x AS (SELECT a.q AS question, a.t AS type_a, b.t AS type_b, greatest(1e-12::DOUBLE, a.p) AS pa, greatest(1e-12::DOUBLE, b.p) AS pb, greatest(1e-12::DOUBLE, (a.p + b.p) / 2) AS m FROM p a JOIN p b ON a.q = b.q AND a.v = b.v AND a.t < b.t),
r AS (SELECT question, type_a, type_b, round(sum(pa * ln(pa / pb)), 6) AS kl_ab, round(sum(pb * ln(pb / pa)), 6) AS kl_ba, round(sum(pa * ln(pa / m)) / 2 + sum(pb * ln(pb / m)) / 2, 6) AS jsd FROM x GROUP BY ALL)
"""


@query(_DIVERGENCE + "SELECT * FROM r ORDER BY jsd DESC, kl_ab DESC, kl_ba DESC, question, type_a, type_b LIMIT 20")
def kl_jsd_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.divergence_rank(_answers(spark, sf_dir), 20)


@query(_DIVERGENCE + "SELECT question, round(avg(jsd), 6) AS mean_jsd, round(avg(jsd), 6) > 0.02::DOUBLE AS flagged FROM r GROUP BY question")
def rater_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rater_disagreement(_answers(spark, sf_dir), 0.02)


_MARKOV = """
RECURSIVE o AS (SELECT user_id AS session, event_type AS axis, value > 50 AS up, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT DISTINCT session, axis, 0::BIGINT AS i, 0.5::DOUBLE AS p, 0.5::DOUBLE AS n FROM o UNION ALL
SELECT m.session, m.axis, o.i, CASE WHEN up THEN p * 0.8::DOUBLE + n * 0.45::DOUBLE ELSE p * 0.55::DOUBLE + n * 0.2::DOUBLE END, CASE WHEN up THEN p * 0.2::DOUBLE + n * 0.55::DOUBLE ELSE p * 0.45::DOUBLE + n * 0.8::DOUBLE END
FROM m JOIN o ON o.session = m.session AND o.axis = m.axis AND o.i = m.i + 1)
"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session").withColumnRenamed("event_type", "axis")
    return stats.markov_fold(events, ["session", "axis"], ["ts", "event_id"], F.col("value") > 50)


@query(f"WITH {_MARKOV} SELECT session, axis, round(p / (p + n), 6) AS p_pos, round(n / (p + n), 6) AS p_neg FROM m QUALIFY row_number() OVER (PARTITION BY session, axis ORDER BY i DESC) = 1")
def markov_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("session", "axis", F.round("p_pos", 6).alias("p_pos"), F.round("p_neg", 6).alias("p_neg"))


_TYPES = ", ".join(f"('{c}', '{m}')" for c, m in geometry.SURVEY_TYPES.items())


@query(f"""
WITH c AS (SELECT c_custkey AS session, (c_custkey % 7 + 1) / 9.0::DOUBLE AS p_e, (c_custkey % 5 + 1) / 7.0::DOUBLE AS p_n, (c_custkey % 11 + 1) / 13.0::DOUBLE AS p_t, (c_custkey % 3 + 1) / 5.0::DOUBLE AS p_j FROM customer),
s AS (SELECT session, code, (CASE WHEN m[1] = 'E' THEN p_e ELSE 1 - p_e END) * (CASE WHEN m[2] = 'N' THEN p_n ELSE 1 - p_n END) * (CASE WHEN m[3] = 'T' THEN p_t ELSE 1 - p_t END) * (CASE WHEN m[4] = 'J' THEN p_j ELSE 1 - p_j END) AS score FROM c, (VALUES {_TYPES}) AS t(code, m)),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(score, 12) DESC, code) <= 5)
SELECT session, code, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY session) * 100, 6) AS pct FROM k
""")
def type_score_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda m, d: ((F.col("c_custkey") % m + 1) / F.lit(float(d)))
    axes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), p(7, 9).alias("p_e"), p(5, 7).alias("p_n"), p(11, 13).alias("p_t"), p(3, 5).alias("p_j"))
    return stats.type_scores(axes, geometry.SURVEY_TYPES).select("session", "code", F.round("score", 6).alias("score"), F.round("pct", 6).alias("pct"))


def _uniformity(deviation: str) -> str:
    return f"SELECT count(*) AS n_axes, arg_min(source, (n, source)) AS min_axis, arg_max(source, (n, source)) AS max_axis, round({deviation}(n) / avg(n), 6) AS uniformity FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"


@query(_uniformity("stddev_pop"))
def uniformity_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.uniformity(table(spark, sf_dir, "documents"), "source", 0)


@query(_uniformity("stddev_samp"))
def uniformity_samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.uniformity(table(spark, sf_dir, "documents"), "source", 1)


_CAPITALS = "unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z][a-z]+$'))[1:10])"


@query(f"SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT {_CAPITALS} AS term FROM documents) GROUP BY term) WHERE n >= 3 AND length(term) >= 3 ORDER BY n DESC, term LIMIT 100")
def term_frequency_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = F.slice(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z][a-z]+$")), 1, 10)
    return stats.term_frequency(table(spark, sf_dir, "documents").select(F.explode(capitals).alias("term")), "term")


@query("""
WITH s AS (SELECT source AS term, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 100),
g AS (SELECT term, count(*) AS n FROM (SELECT source AS term FROM documents UNION ALL SELECT event_type FROM events) WHERE length(term) >= 3 GROUP BY 1 HAVING count(*) >= 3)
SELECT 'special' AS list, term, n FROM s UNION ALL (SELECT 'general', term, n FROM g WHERE term NOT IN (SELECT term FROM s) ORDER BY n DESC, term LIMIT 25)
""")
def term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = table(spark, sf_dir, "documents").select(F.col("source").alias("term"))
    return stats.term_lists(special, special.unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("term"))), "term")


@query("""
WITH b AS (SELECT count(*) AS both_ids FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels))
SELECT (SELECT count(*) FROM documents) AS n_profiles, (SELECT count(*) FROM labels) AS n_vectors, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS duplicate_ids,
(SELECT count(*) FROM documents WHERE trim(coalesce(lang, '')) = '') AS missing_names, both_ids AS intersection,
(SELECT count(DISTINCT doc_id) FROM labels) - both_ids AS vectors_without_profile, (SELECT count(DISTINCT doc_id) FROM documents) - both_ids AS profiles_without_vector,
least((SELECT count(DISTINCT doc_id) FROM documents), (SELECT count(DISTINCT doc_id) FROM labels)) - ((SELECT count(DISTINCT doc_id) FROM labels) - both_ids) AS legacy_intersection FROM b
""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.health_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_col="doc_id", name_col="lang")


@query("""
SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.source
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("h", F.lit(1))
    joined = table(spark, sf_dir, "documents").join(have, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("h").alias("labelled"))
    return joined.withColumn("share", F.round(F.col("labelled") / F.col("n"), 6))


@query("""
SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) <= 5
""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest sources of each list."""
    counted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("r <= 5").drop("r")


@query("SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def diagnose_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""
WITH c AS (SELECT user_id AS u, event_type AS v, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY u) AS m FROM c), k AS (SELECT * FROM s WHERE m > 1),
w AS (SELECT u, any_value(m) AS m, sum(n * (n - 1)) AS agree FROM k GROUP BY u), t AS (SELECT sum((m * (m - 1) - agree) / (m - 1)::DOUBLE) AS observed, sum(m) AS total, count(*) AS units FROM w),
g AS (SELECT sum(n * (n - 1)) AS same FROM (SELECT v, sum(n) AS n FROM k GROUP BY v))
SELECT round(1 - (observed / total) / ((total * (total - 1) - same) / (total * (total - 1))::DOUBLE), 6) AS alpha, units FROM t, g
""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.krippendorff_alpha(table(spark, sf_dir, "events"), unit="user_id", value="event_type")


@query("""
WITH w AS (SELECT floor(epoch(ts) / 604800) AS b, avg(value) AS m FROM events GROUP BY 1) SELECT CAST(b * 604800 AS BIGINT) AS week, round(m, 6) AS mean, round(avg(m) OVER (ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM w
""")
def weekly_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.moving_average(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value")
    return out.select(F.unix_timestamp(F.col("week").cast("timestamp")).alias("week"), F.round("mean", 6).alias("mean"), F.round("moving", 6).alias("moving"))


_SHIFT = """
WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS t FROM conversations),
c AS (SELECT conv_id, turn, CAST(('0x' || substr(sha256(t), 63, 2))::INTEGER % 64 AS INTEGER) AS b, count(*)::DOUBLE AS n FROM t GROUP BY ALL), m AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL),
s AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS d FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.b = b.b GROUP BY ALL)
SELECT v.conv_id, v.turn, round(CASE WHEN p.turn IS NULL THEN NULL ELSE coalesce(s.d / (m.norm * q.norm), 0) END, 6) AS similarity, coalesce(round(CASE WHEN p.turn IS NULL THEN NULL ELSE coalesce(s.d / (m.norm * q.norm), 0) END, 6) < 0.55::DOUBLE, false) AS shift
FROM conversations v LEFT JOIN conversations p ON p.conv_id = v.conv_id AND p.turn = v.turn - 1 LEFT JOIN m ON m.conv_id = v.conv_id AND m.turn = v.turn LEFT JOIN m q ON q.conv_id = v.conv_id AND q.turn = v.turn - 1 LEFT JOIN s ON s.conv_id = v.conv_id AND s.turn = v.turn
"""


@query(_SHIFT)
def topic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose hash embedding is under 0.55 cosine from that of the turn before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), "text")
    parts = search.hash_embedding_buckets(turns, id_col="key").select("key.conv_id", "key.turn", "bucket", "weight")
    after = parts.select("conv_id", (F.col("turn") + 1).alias("turn"), "bucket", F.col("weight").alias("before"))
    products = parts.join(after, ["conv_id", "turn", "bucket"]).groupBy("conv_id", "turn").agg(F.sum(F.col("weight") * F.col("before")).alias("d"))
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has"))
    joined = turns.select("conv_id", "turn").join(previous, ["conv_id", "turn"], "left").join(products, ["conv_id", "turn"], "left")
    score = F.round(F.when(F.col("has"), F.coalesce("d", F.lit(0.0))), 6)
    return stats.topic_shift(joined, score, keys=["conv_id"], order="turn").select("conv_id", "turn", "similarity", "shift")


@query("""
WITH p AS (SELECT user_id, event_id, CASE WHEN value > 60 THEN 1 ELSE 0 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM p),
b AS (SELECT *, sum(1 - fresh) OVER (PARTITION BY user_id, g ORDER BY event_id) AS barren FROM g), s AS (SELECT *, coalesce(max(CASE WHEN barren >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM b)
SELECT user_id, event_id FROM s WHERE stopped = 0
""")
def no_progress_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 60, 1).otherwise(0).alias("fresh"))
    return stats.no_progress_stop(pages, keys=["user_id"], order="event_id", new_col="fresh", limit=3).select("user_id", "event_id")


@query("""
WITH RECURSIVE c AS (SELECT user_id, event_id AS call_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, call_id, true AS allowed, t AS last FROM c WHERE n = 1
UNION ALL SELECT c.user_id, c.n, c.call_id, f.last < c.t - 60, CASE WHEN f.last < c.t - 60 THEN c.t ELSE f.last END FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)
SELECT user_id, call_id, allowed FROM f
""")
def rate_limit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one recorded event of a user in any minute: a fold over state."""
    calls = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return messages.rate_limited(calls, 1).select("user_id", "call_id", "allowed")


_LIMITS = ((1, 600.0), (3, 3600.0), (10, 10_800.0))


@query(f"""
WITH RECURSIVE l AS (SELECT * FROM (VALUES {', '.join(f'({n}, {s}::DOUBLE)' for n, s in _LIMITS)}) AS l(lim, seconds)),
c AS (SELECT event_type, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT lim, seconds, event_type, n, event_id, true AS allowed, [t] AS held FROM c, l WHERE n = 1
UNION ALL SELECT lim, seconds, event_type, n, event_id, len(live) < lim, CASE WHEN len(live) < lim THEN list_append(live, t) ELSE live END
FROM (SELECT f.lim, f.seconds, c.event_type, c.n, c.event_id, c.t, list_filter(f.held, lambda x: x >= c.t - f.seconds) AS live FROM f JOIN c ON c.event_type = f.event_type AND c.n = f.n + 1))
SELECT CAST(lim AS INTEGER) AS calls, event_type, event_id, allowed FROM f
""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 1 event of a type in ten minutes, 3 in an hour, 10 in three hours; rejected events are not recorded."""
    calls = table(spark, sf_dir, "events").select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    limited = [messages.rate_limited(calls, n, seconds=s, user_col="event_type", tie_col="event_id").select(F.lit(n).alias("calls"), "event_type", "event_id", "allowed") for n, s in _LIMITS]
    return reduce(DataFrame.unionByName, limited)


_HOURLY = f"""
WITH RECURSIVE c AS (SELECT event_type, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_type, n, event_id, true AS allowed, [t] AS held FROM c WHERE n = 1
UNION ALL SELECT event_type, n, event_id, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
FROM (SELECT c.event_type, c.n, c.event_id, c.t, list_filter(f.held, lambda x: x >= c.t - 3600) AS live FROM f JOIN c ON c.event_type = f.event_type AND c.n = f.n + 1))
SELECT event_type, event_id, allowed FROM f
"""


@query(_HOURLY)
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 events of a type in an hour, from a stream whose events come up to two days late."""
    calls = table(spark, sf_dir, "events").select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    source, out, state = (scratch(spark, n) for n in ("calls", "limited", "limiter"))
    delayed = calls.withColumn("seen", F.floor((F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(48)) * 3600) / (86_400 * 8)))
    for part in sorted(r["seen"] for r in delayed.select("seen").distinct().collect()):  # a file or so for each eight days
        delayed.where(F.col("seen") == part).drop("seen").write.mode("append").parquet(source)
    end = calls.agg((F.max("t") + 86_400 * 30).alias("t")).select(F.lit("").alias("event_type"), F.lit(-1).cast("long").alias("event_id"), "t")
    end.write.mode("append").parquet(source)  # the watermark passes all events
    held = spark.conf.get(limiter._CONF, None)
    spark.conf.set(limiter._CONF, limiter.PROVIDER)
    try:
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 4).parquet(source)
        limited = limiter.rate_limited_in_order(stream, 3, seconds=3600.0, user_col="event_type", tie_col="event_id", late="11 days")
        limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(limiter._CONF) if held is None else spark.conf.set(limiter._CONF, held)
    return spark.read.schema(limited.schema).parquet(out).where("event_id >= 0").select("event_type", "event_id", "allowed")


@query("SELECT event_type, CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return messages.windowed_counts(events, time_col="ts", keys=("event_type",)).select("event_type", F.unix_timestamp("start").alias("start"), "n")


@query("""
WITH s AS (SELECT * FROM events ORDER BY event_id LIMIT 1000) SELECT event_type, count(*) AS n, CAST(round(count(*) * (SELECT count(*) FROM events) / (SELECT count(*) FROM s)::DOUBLE) AS BIGINT) AS estimate FROM s GROUP BY 1
""")
def sample_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts of the first 1000 rows by id, scaled to the table: the sample is the operator."""
    events = table(spark, sf_dir, "events")
    sample = events.orderBy("event_id").limit(1000)
    sizes = events.agg(F.count("*").alias("total")).join(sample.agg(F.count("*").alias("taken")))
    return sample.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(sizes)).select("event_type", "n", F.round(F.col("n") * F.col("total") / F.col("taken")).cast("long").alias("estimate"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\bdiagnos(e|is|tic)\\b', 'i') THEN '[REDACTED_FOR_GUARDRAIL]' ELSE md5(text) END AS shown FROM conversations")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.redacted(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kept == F.col("text"), F.md5(F.col("text").cast("binary"))).otherwise(kept).alias("shown"))
