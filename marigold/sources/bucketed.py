"""Tables in hash buckets of a key, whose updates rewrite the buckets they touch and no others.

A table is a folder: `manifest/<version>` says for each bucket which folder holds it, `data/<write>/bucket=<n>` holds its rows. An upsert
reads the batch's buckets, applies it, writes them to a new data folder and publishes a manifest that points there for these buckets and
to the former folders for the others. A version is published by a rename that fails if another writer came first (on file systems that
rename atomically); readers see a whole version or the one before it. Versions stay readable until vacuum(), which must not run beside a
writer.

The number of buckets is a table's own (and bounded: the manifest is read by the driver). A batch of random keys touches as many buckets
as it has keys, so choose many small buckets for small batches; rebucket() changes the number.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigold.operators import store

MOST_BUCKETS = 65_536


class Conflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class BucketedTable:
    spark: SparkSession
    path: str

    def _fs(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        """{keys, n_buckets, schema, buckets}: buckets maps a number to its data folder; empty buckets are not in it."""
        last = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{last}", wholetext=True).first()[0])  # MOST_BUCKETS names at most

    def _publish(self, version: int, content: dict) -> None:
        fs, staged = self._fs(f"{self.path}/staged-{uuid.uuid4().hex}")
        _, target = self._fs(f"{self.path}/manifest/{version}")
        fs.mkdirs(target.getParent())
        out = fs.create(staged)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise Conflict(f"version {version} of {self.path} is there")

    def _written(self, rows: DataFrame, keys: Sequence[str], n: int) -> dict[str, str]:
        """Rows with their bucket in a new data folder; the folder of each bucket that has rows."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", bucket_of(keys, n))
        placed.repartitionByRange("bucket", *keys).write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")  # large buckets are split by key
        fs, folder = self._fs(f"{self.path}/data/{name}")
        found = (re.fullmatch(r"bucket=(\d+)", s.getPath().getName()) for s in fs.listStatus(folder))
        return {m[1]: name for m in found if m}

    def _read(self, content: dict, buckets: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(content["schema"]))
        paths = [f"{self.path}/data/{content['buckets'][b]}/bucket={b}" for b in buckets if b in content["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        content = self.manifest(version)
        return self._read(content, list(content["buckets"]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose keys are in a small table: only the buckets of those keys are read."""
        content = self.manifest()
        return self._read(content, _touched(keys, content)).join(keys.select(*content["keys"]).distinct(), content["keys"], "left_semi")

    def upsert(self, batch: DataFrame, value: str, order: Sequence[str] = ()) -> dict[str, int]:
        """Applies a batch (keys, value), the last of a key by `order`; {new, updated, same, touched}. Unchanged buckets are not written,
        and a batch that changes nothing makes no version."""
        version, content = self.versions()[-1], self.manifest()
        keys, batch = content["keys"], batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in content["keys"]))
        touched = _touched(batch, content)
        applied = store.upsert(self._read(content, touched), batch, keys, value, order).withColumn("bucket", bucket_of(keys, content["n_buckets"]))
        counts = {r["bucket"]: r for r in applied.groupBy("bucket").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "updated"))).collect()}  # a row for each touched bucket
        changed = [b for b, r in counts.items() if r["new"] or r["updated"]]
        asked = batch.select(*keys).distinct().count()
        done = {s: sum(r[s] for r in counts.values()) for s in ("new", "updated")}
        if changed:
            rows = applied.where(F.col("bucket").isin(changed)).select(*(F.col(f"`{f['name']}`") for f in json.loads(content["schema"])["fields"]))
            fresh = self._written(rows, keys, content["n_buckets"])
            self._publish(version + 1, content | {"buckets": content["buckets"] | fresh})
        return done | {"same": asked - done["new"] - done["updated"], "touched": len(changed)}

    def append_missing(self, batch: DataFrame) -> int:
        """Adds the batch's rows whose keys the table lacks, each key once; how many. Buckets that gain nothing are not written."""
        version, content = self.versions()[-1], self.manifest()
        keys, n = content["keys"], content["n_buckets"]
        held = self._read(content, _touched(batch, content))
        columns = held.columns
        fresh = batch.select(*columns).dropDuplicates(keys).join(held, keys, "left_anti").withColumn("bucket", bucket_of(keys, n))
        gained = {r["bucket"]: r["n"] for r in fresh.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        if gained:
            whole = fresh.drop("bucket").unionByName(held.where(bucket_of(keys, n).isin(list(gained))))
            self._publish(version + 1, content | {"buckets": content["buckets"] | self._written(whole, keys, n)})
        return sum(gained.values())

    def delete(self, keys: DataFrame) -> int:
        """Removes rows by key; how many. Only buckets that lose rows are written."""
        version, content = self.versions()[-1], self.manifest()
        names, n = content["keys"], content["n_buckets"]
        held = self._read(content, _touched(keys, content)).withColumn("bucket", bucket_of(names, n))
        lost = {r["bucket"]: r["n"] for r in held.join(keys.select(*names).distinct(), names, "left_semi").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        if lost:
            rest = held.where(F.col("bucket").isin(list(lost))).drop("bucket").join(keys.select(*names).distinct(), names, "left_anti")
            kept = {b: f for b, f in content["buckets"].items() if int(b) not in lost}
            self._publish(version + 1, content | {"buckets": kept | self._written(rest, names, n)})
        return sum(lost.values())

    def rebucket(self, n_buckets: int) -> None:
        """A new version with another number of buckets."""
        version, content = self.versions()[-1], self.manifest()
        self._publish(version + 1, content | {"n_buckets": _bounded(n_buckets), "buckets": self._written(self.read(), content["keys"], n_buckets)})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last versions and the data folders that those do not name; how many folders went."""
        kept = self.versions()[-keep:]
        named = {(f, b) for v in kept for b, f in self.manifest(v)["buckets"].items()}
        gone = 0
        for v in self.versions()[:-keep]:
            fs, target = self._fs(f"{self.path}/manifest/{v}")
            fs.delete(target, False)
        fs, data = self._fs(f"{self.path}/data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            name = folder.getPath().getName()
            for b in fs.listStatus(folder.getPath()):
                m = re.fullmatch(r"bucket=(\d+)", b.getPath().getName())
                if m and (name, m[1]) not in named:
                    gone += bool(fs.delete(b.getPath(), True))
        return gone


def bucket_of(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(n)).cast("int")


def _bounded(n: int) -> int:
    if not 0 < n <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")
    return n


def _touched(batch: DataFrame, content: dict) -> list[str]:
    return [str(r["bucket"]) for r in batch.select(bucket_of(content["keys"], content["n_buckets"]).alias("bucket")).distinct().collect()]  # as many as buckets at most


def create(df: DataFrame, path: str, keys: Sequence[str], n_buckets: int) -> BucketedTable:
    """Version 0 of a table, of the rows of df. Keys are unique; rows with a null key are not taken."""
    table = BucketedTable(df.sparkSession, path)
    if table.versions():
        raise Conflict(f"{path} is a table")
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    content = {"keys": list(keys), "n_buckets": _bounded(n_buckets), "schema": df.schema.json(), "buckets": table._written(rows, keys, n_buckets)}
    table._publish(0, content)
    return table
