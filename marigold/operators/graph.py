"""Relationship graphs: degrees, undirected connected components and edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigold.lineage import dropped, written


def degrees(edges: DataFrame, src: str = "from_pid", dst: str = "to_pid") -> DataFrame:
    """(pid, out_degree, in_degree, degree): edges that leave and enter each node; repeated edges count, nulls do not."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("pid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("pid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    summed = ends.where("pid IS NOT NULL").groupBy("pid").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"))
    return summed.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def connected_components(edges: DataFrame, src: str = "from_pid", dst: str = "to_pid", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of an edge. Edges with a null end take no part.

    Each round finds the least label of a node's neighbours, gives it to the node and to the node that is its label so far, so that
    whole trees are hooked at once, and then takes the label of that label. Rounds grow with the logarithm of the diameter in most
    graphs. Every round's labels are a written table; a hot node's edges meet a table with one row per node, a join that adaptive
    execution can split."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        told = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        least = F.least("component", "m").alias("c")
        own, tree = F.struct("node", least, F.col("component").alias("before")), F.struct(F.col("component").alias("node"), least, F.lit(None).cast(labels.schema["node"].dataType).alias("before"))
        offered = labels.join(told, "node").select(F.explode(F.array(own, tree)).alias("o")).select("o.*")
        lower = offered.groupBy("node").agg(F.min("c").alias("c"), F.min("before").alias("before"))
        onward = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        step = written(lower.join(onward, "c", "left").select("node", F.coalesce("further", "c").alias("component"), "before"), "labels")
        settled = step.where(F.col("component") != F.col("before")).isEmpty()
        dropped(labels)
        labels = step
        if settled:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return labels.select("node", "component")


def component_export(edges: DataFrame, src: str = "from_pid", dst: str = "to_pid") -> DataFrame:
    """(pid, component, out_degree, in_degree, degree) of every node of an edge."""
    return degrees(edges, src, dst).join(connected_components(edges, src, dst).withColumnRenamed("node", "pid"), "pid").select("pid", "component", "out_degree", "in_degree", "degree")
