"""Agreement of raters on the driver's tables: users as units, event types or classes of values as ratings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.operators import agreement
from marigold.registry import query, table

_CELLS = "n AS (SELECT w, u, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY w, u) AS m FROM n QUALIFY m > 1)"


def _alpha(rows: str) -> str:
    """Nominal alpha by group w of cells (w, u, v, n, m)."""
    return f"""(SELECT w, round(CASE WHEN t * t = same THEN 1 ELSE 1 - observed * (t - 1) / (t * t - same) END, 6) AS alpha
FROM (SELECT w, sum(d) AS observed FROM (SELECT w, u, (any_value(m) * (any_value(m) - 1) - sum(n * (n - 1)))::DOUBLE / (any_value(m) - 1) AS d FROM {rows} GROUP BY w, u, part) GROUP BY w)
JOIN (SELECT w, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS same FROM (SELECT w, v, sum(n) AS n FROM {rows} GROUP BY w, v) GROUP BY w) USING (w))"""


@query(f"""
WITH r AS (SELECT CAST(floor(epoch(ts) / 604800) AS INTEGER) AS w, user_id AS u, event_type AS v FROM events), {_CELLS}, one AS (SELECT *, w AS part FROM m),
three AS (SELECT m.w + s AS w, u, v, n, m, m.w AS part FROM m, (SELECT unnest(range(3)) AS s) WHERE m.w + s IN (SELECT w FROM m)),
a AS {_alpha('one')}, t AS {_alpha('three')}, mv AS (SELECT x.w, round(avg(y.alpha), 6) AS moving FROM a x JOIN a y ON y.w BETWEEN x.w - 2 AND x.w GROUP BY x.w)
SELECT a.w AS week, a.alpha, t.alpha AS merged, moving, moving < 0.667 AS recalibrate FROM a JOIN t USING (w) JOIN mv USING (w)
""")
def weekly_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each week, of three weeks together, its moving mean and the trigger."""
    events = table(spark, sf_dir, "events").withColumn("week", agreement.week_of(F.col("ts")))
    return agreement.weekly_reliability(events, unit="user_id", value="event_type", week="week")


@query("""
WITH r AS (SELECT user_id AS u, CAST(floor(value / 20) AS BIGINT) AS v FROM events WHERE value IS NOT NULL), p AS (SELECT *, count(*) OVER (PARTITION BY u) AS m FROM r QUALIFY m > 1),
o AS (SELECT a.v AS c, b.v AS k, sum(a.n * (b.n - CASE WHEN a.v = b.v THEN 1 ELSE 0 END)::DOUBLE / (a.m - 1)) AS o FROM (SELECT u, v, m, count(*) AS n FROM p GROUP BY ALL) a JOIN (SELECT u, v, count(*) AS n FROM p GROUP BY ALL) b USING (u) GROUP BY ALL),
g AS (SELECT c, sum(o) AS n FROM o GROUP BY c), t AS (SELECT sum(n) AS t FROM g),
d AS (SELECT x.c, y.c AS k, x.n AS nc, y.n AS nk, pow(x.c - y.c, 2) AS interval, pow((SELECT sum(n) FROM g WHERE g.c BETWEEN least(x.c, y.c) AND greatest(x.c, y.c)) - (x.n + y.n) / 2, 2) * CASE WHEN x.c = y.c THEN 0 ELSE 1 END AS ordinal, CASE WHEN x.c = y.c THEN 0 ELSE 1 END AS nominal FROM g x, g y),
e AS (SELECT metric, sum(nc * nk * dist) / (any_value(t) - 1) AS expected, sum(coalesce(o, 0) * dist) AS observed FROM (UNPIVOT (SELECT d.c, d.k, nc, nk, interval::DOUBLE AS interval, ordinal::DOUBLE AS ordinal, nominal::DOUBLE AS nominal FROM d) ON interval, ordinal, nominal INTO NAME metric VALUE dist) AS d LEFT JOIN o USING (c, k), t GROUP BY metric)
SELECT metric, round(1 - observed / expected, 6) AS alpha FROM e
""")
def alpha_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal, ordinal and interval alpha of values in five classes."""
    states = agreement.coincidences(table(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") / 20)), unit="user_id", value="v")
    each = [agreement.alpha(states, m).select(F.lit(m).alias("metric"), "alpha") for m in ("nominal", "ordinal", "interval")]
    return each[0].unionByName(each[1]).unionByName(each[2])


_BOUNDS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


@query(f"""
WITH r AS (SELECT 0 AS w, user_id AS u, event_type AS v FROM events WHERE user_id IS NOT NULL), {_CELLS}, s AS (SELECT unnest(range(200)) AS r),
x AS (SELECT r, u, ('0x' || substr(md5(u || ':' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS d FROM (SELECT DISTINCT u FROM m), s), k AS (SELECT r, u, {' + '.join(f'CASE WHEN d >= {b!r}::DOUBLE THEN 1 ELSE 0 END' for b in _BOUNDS)} AS k FROM x),
o AS (SELECT r, sum(k * d) AS observed, sum(k * m) AS t FROM (SELECT u, any_value(m) AS m, (any_value(m) * (any_value(m) - 1) - sum(n * (n - 1)))::DOUBLE / (any_value(m) - 1) AS d FROM m GROUP BY u) JOIN k USING (u) GROUP BY r),
g AS (SELECT r, sum(n * n) AS same FROM (SELECT r, v, sum(k * n) AS n FROM m JOIN k USING (u) GROUP BY r, v) GROUP BY r), a AS (SELECT 1 - observed * (t - 1) / (t * t - same) AS alpha FROM o JOIN g USING (r))
SELECT round(quantile_cont(alpha, 0.025), 6) AS low, round(quantile_cont(alpha, 0.975), 6) AS high, count(*) AS replicates FROM a
""")
def alpha_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for the nominal alpha from 200 resamples of the users."""
    return agreement.bootstrap_alpha(table(spark, sf_dir, "events"), unit="user_id", value="event_type")


@query("""
WITH c AS (SELECT user_id AS u, event_type AS r, avg(value) AS x FROM events WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT count(DISTINCT r) AS k FROM c), f AS (SELECT c.* FROM c JOIN (SELECT u, count(*) AS n FROM c GROUP BY u) USING (u), k WHERE n = k),
g AS (SELECT avg(x) AS g, count(DISTINCT u) AS n FROM f), s AS (SELECT sum(pow(rm - g, 2)) AS ssr, sum(pow(cm - g, 2)) AS ssc, sum(pow(x - g, 2)) AS sst, any_value(n) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY u) AS rm, avg(x) OVER (PARTITION BY r) AS cm FROM f), g),
q AS (SELECT ssr / (n - 1) AS r, ssc / (k - 1) AS c, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS e, n, k FROM s, k)
SELECT round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 6) AS icc_agreement, round((r - e) / (r + (k - 1) * e), 6) AS icc_consistency, n AS units, k AS raters, (SELECT count(DISTINCT u) FROM c) - n AS incomplete FROM q
""")
def icc_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as raters of users."""
    return agreement.icc_two_way(table(spark, sf_dir, "events"), unit="user_id", rater="event_type", value="value")
