"""A breadth-first scan that keeps its state: what was reached at which level, and what is not to be expanded.

State is a folder: `reached/level=<n>/bucket=<m>` holds the nodes of a level in hash buckets, `skipped` those whose expansion failed or is
not wanted. A level is written beside the state and moved there whole, so that an interrupted run leaves complete levels, and the next
run goes on from the last one: with the same edges, runs that stop anywhere and one run that does not give the same table. New seeds
start again at level 0 of a later run's first step: they join the last level, as nodes not expanded yet.

A step reads the edges of its frontier and those buckets of the reached nodes that its candidates fall into.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.lineage import dropped, written
from marigold.sources.readers import exists, parquet_or_empty


@dataclass(frozen=True)
class ScanState:
    spark: SparkSession
    path: str
    node_type: str = "long"
    buckets: int = 64

    def _bucket(self):
        return F.pmod(F.xxhash64("node"), F.lit(self.buckets)).cast("int")

    def _fs(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def reached(self) -> DataFrame:
        """(node, level, bucket): all levels so far."""
        return parquet_or_empty(self.spark, f"{self.path}/reached", f"node {self.node_type}, level int, bucket int")

    def skipped(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/skipped", f"node {self.node_type}")

    def skip(self, nodes: DataFrame) -> None:
        """Nodes (one column) that no later step expands; they can still be reached."""
        nodes.select(F.col(nodes.columns[0]).cast(self.node_type).alias("node")).where("node IS NOT NULL").write.mode("append").parquet(f"{self.path}/skipped")

    def levels(self) -> int:
        """Complete levels."""
        n = 0
        while exists(self.spark, f"{self.path}/reached/level={n}"):
            n += 1
        return n

    def _add(self, nodes: DataFrame, level: int) -> bool:
        """Writes the nodes that are new as a level; whether there are any."""
        asked = written(nodes.select(F.col(nodes.columns[0]).cast(self.node_type).alias("node")).where("node IS NOT NULL").distinct().withColumn("bucket", self._bucket()), "asked")
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as buckets at most
        known = self.reached().where(F.col("bucket").isin(touched)).select("node")
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        asked.join(known, "node", "left_anti").repartitionByRange("bucket", "node").write.partitionBy("bucket").parquet(staged)
        dropped(asked)
        fs, source = self._fs(staged)
        found = any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(source))
        if found:
            _, target = self._fs(f"{self.path}/reached/level={level}")
            fs.mkdirs(target.getParent())
            if fs.exists(target) or not fs.rename(source, target):
                raise RuntimeError(f"another run wrote level {level} of {self.path}")
        else:
            fs.delete(source, True)
        return found

    def advance(self, edges: DataFrame, seeds: DataFrame | None = None, *, steps: int | None = None, src: str = "from_pid", dst: str = "to_pid") -> int:
        """Goes on for some steps, or until nothing new is reached; how many levels were added. Seeds count in the first run alone or, if
        they are new, as a level of their own that is expanded with the last one."""
        begun = self.levels()
        n = begun
        first = n - 1
        if seeds is not None and self._add(seeds, n):
            n, first = n + 1, max(0, n - 1)
        taken = 0
        while n and (steps is None or taken < steps):
            frontier = self.reached().where((F.col("level") >= first) & (F.col("level") < n)).select("node").join(self.skipped().distinct(), "node", "left_anti")
            if not self._add(edges.join(frontier.select(F.col("node").alias(src)), src, "left_semi").select(dst), n):
                break
            first, n, taken = n, n + 1, taken + 1
        return n - begun
