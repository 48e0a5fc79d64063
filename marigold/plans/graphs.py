"""Graph queries on the driver's tables: parts and suppliers are nodes, line items edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.operators import graph
from marigold.registry import query, table


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_pid"), (F.col("l_suppkey") + 1_000_000).alias("to_pid"))


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts p to p + 1 unless 7 divides p, and p to p + 70 where p is 3 modulo 70 and below 900: components of several parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    near = parts.where("p % 7 <> 0").select(F.col("p").alias("from_pid"), (F.col("p") + 1).alias("to_pid"))
    return near.unionByName(parts.where("p % 70 = 3 AND p < 900").select(F.col("p").alias("from_pid"), (F.col("p") + 70).alias("to_pid")))


_DEGREES = """
WITH e AS (SELECT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), o AS (SELECT a AS pid, count(*) AS n FROM e GROUP BY a), i AS (SELECT b AS pid, count(*) AS n FROM e GROUP BY b),
d AS (SELECT coalesce(o.pid, i.pid) AS pid, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) + coalesce(i.n, 0) AS BIGINT) AS degree FROM o FULL JOIN i ON o.pid = i.pid)
"""


@query(_DEGREES + "SELECT * FROM d")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(supply_edges(spark, sf_dir))


@query(_DEGREES + "SELECT * FROM d ORDER BY degree DESC, pid LIMIT 10")
def graph_top_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(supply_edges(spark, sf_dir)).orderBy(F.desc("degree"), "pid").limit(10)


_CHAIN = """
RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, p_partkey + 70 FROM part WHERE p_partkey % 70 = 3 AND p_partkey < 900),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
"""


@query(f"WITH {_CHAIN} SELECT * FROM c")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(chain_edges(spark, sf_dir))


@query(f"""
WITH {_CHAIN}, o AS (SELECT a AS pid, count(*) AS n FROM e GROUP BY a), i AS (SELECT b AS pid, count(*) AS n FROM e GROUP BY b)
SELECT c.node AS pid, component, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) + coalesce(i.n, 0) AS BIGINT) AS degree
FROM c LEFT JOIN o ON o.pid = c.node LEFT JOIN i ON i.pid = c.node
""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_export(chain_edges(spark, sf_dir))
