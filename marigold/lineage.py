"""Cutting lineage with tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: spark.checkpoint.dir where it is set; a temporary one on a local master, an error on a cluster."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="marigold-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/marigold-{uuid.uuid4().hex}-{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: For tables whose rows hold megabytes each: Parquet's writer looks at its size after every row (as a rule, after 100), and a row group,
#: which it and the reader hold as a whole, ends at 8 MB.
HEAVY = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def written(df: DataFrame, name: str = "table", *, heavy: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and a lost executor costs no recomputation. heavy: rows
    of megabytes each.

    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**(HEAVY if heavy else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside sends Arrow batches of about n bytes (as a rule 64 MB, which a task holds several times)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/marigold-" in path:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
