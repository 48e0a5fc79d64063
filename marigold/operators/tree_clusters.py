"""k-means of any k: a tree of clusters, whose centres are a table.

Equal vectors are one weighted point, counted before the shuffle, so that a vector of very many rows is no load. A
level splits every open node into at most FAN parts by Lloyd rounds inside the node, then deals the node's number of clusters to the
parts in proportion to their distinct vectors, at least one each. A part with one cluster is a leaf and is read no more. A row meets the FAN centres of
its own node alone, so that a level costs FAN distances a row at every k, and no more than FAN centres are ever in one row of the centres'
table; the driver holds none. The table of centres is written, with one row per node, so that a join with a node of very many rows can be
split by adaptive execution.

First centres are a node's points of least hash in FAN hash classes; a node whose points fall into one class is tried again. There are k clusters, or one for each distinct vector where these are
fewer. Results: null vectors belong to
no cluster and go; vectors of another length count as padded by zeros or cut; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.lineage import dropped, written
from marigold.operators.stats import dimension_mode

FAN = 32


def _nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with `_child`, the number of their node's nearest centre, and `distance` (squared) to it."""
    best = F.array_min(F.transform("_centres", lambda c: F.struct(vectors.squared_distance(F.col("_x"), c["centre"]).alias("distance"), c["child"].alias("child"))))
    return rows.join(centres, "_node").withColumn("_best", best).drop("_centres").select("*", F.col("_best.child").alias("_child"), F.col("_best.distance").alias("distance")).drop("_best")


def _listed(centres: DataFrame) -> DataFrame:
    return centres.groupBy("_node").agg(F.array_sort(F.collect_list(F.struct("child", "centre"))).alias("_centres"))  # at most FAN


def _path() -> Column:
    return F.concat_ws(".", F.nullif("_node", F.lit("")), F.lpad(F.col("_child").cast("string"), 2, "0"))


def tree_kmeans(df: DataFrame, k: int, *, vector_col: str = "embedding", seed: int = 42, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(df with `cluster` (text, the path of parts from the root) and `distance` to its centre, squared; table (cluster, size, centre))."""
    if k < 1 or rounds < 1:
        raise ValueError("at least one cluster and one round")
    taken = [c for c in ("_x", "distance", "cluster") if c in df.columns]
    if taken:
        raise ValueError(f"columns of these names are in use: {taken}")
    mode = dimension_mode(df, vector_col).first()
    d = int(mode["dimension"]) if mode is not None else 0
    held = df.where(F.col(vector_col).isNotNull()).withColumn("_x", vectors.sanitized(F.col(vector_col), d) if d else F.array().cast("array<double>"))
    points = written(held.groupBy("_x").agg(F.count("*").alias("_w")), "points")
    open_rows = points.select("_x", "_w", F.lit("").alias("_node"), F.least(F.lit(k).cast("long"), F.lit(points.count())).alias("_k"))
    leaves, tables, level = [], [], 0
    while not open_rows.isEmpty():
        hashed = F.xxhash64("_x", F.lit(seed + level))
        firsts = open_rows.groupBy("_node", F.pmod(F.shiftright(hashed, 8), F.least(F.lit(FAN).cast("long"), "_k")).cast("int").alias("child")).agg(F.min_by("_x", F.struct(hashed, "_x")).alias("centre"))
        centres = written(_listed(firsts), "centres")
        for _ in range(rounds):
            # sums of equal numbers in any order differ in the last bits; rounding keeps runs alike
            weighted = F.expr(f"array({', '.join(f'round(sum(_x[{i}] * _w) / sum(_w), 12)' for i in range(d))})")
            means = _nearest(open_rows, centres).groupBy("_node", F.col("_child").alias("child")).agg(weighted.alias("centre"))
            last, centres = centres, written(_listed(means), "centres")
            dropped(last)
        placed = written(_nearest(open_rows, centres), "placed")
        each = placed.groupBy("_node", "_k", "_child").agg(F.count("*").alias("n"), F.sum("_w").alias("size"))
        w = Window.partitionBy("_node")  # at most FAN rows a node
        spare, room = F.col("_k") - F.col("parts"), F.col("total") - F.col("parts")
        upto = lambda x: F.when(room > 0, F.floor(spare * x / room)).otherwise(0)
        shares = each.withColumn("parts", F.count("*").over(w)).withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum(F.col("n") - 1).over(w.orderBy("_child")) - F.col("n") + 1)
        part = F.when(F.col("parts") == 1, F.when(F.col("n") == 1, 1).otherwise(F.col("_k"))).otherwise(1 + upto(F.col("before") + F.col("n") - 1) - upto(F.col("before"))).cast("long")
        dealt = written(shares.select("_node", "_child", "size", part.alias("_part"), _path().alias("_path")), "dealt")
        named = placed.drop("_k").join(dealt.drop("size"), ["_node", "_child"])
        leaves.append(written(named.where("_part = 1").select("_x", F.col("_path").alias("cluster"), "distance"), "leaves"))
        flat = centres.select("_node", F.inline("_centres")).withColumnRenamed("child", "_child")
        tables.append(dealt.where("_part = 1").join(flat, ["_node", "_child"]).select(F.col("_path").alias("cluster"), "size", "centre"))
        last, open_rows = open_rows, written(named.where("_part > 1").select("_x", "_w", F.col("_path").alias("_node"), F.col("_part").alias("_k")), "node")
        dropped(last)
        dropped(placed)
        level += 1
    if not leaves:
        none = held.withColumn("cluster", F.lit("")).withColumn("distance", F.lit(0.0)).drop("_x")
        return none, df.sparkSession.createDataFrame([], "cluster string, size long, centre array<double>")
    return held.join(functools.reduce(DataFrame.unionAll, leaves), "_x").drop("_x"), functools.reduce(DataFrame.unionAll, tables)
