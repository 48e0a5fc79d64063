"""Sinks: atomic table replacement, exports with arrays as JSON where the format has none, and audit logs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigold.sources.readers import exists


def _paths(spark: SparkSession, *names: str):
    jvm = spark.sparkContext._jvm
    found = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def replace_parquet(df: DataFrame, path: str, *, keep_previous: str | None = None) -> None:
    """Writes beside the table and swaps by two renames, so that df may read the old table and no reader sees a half-written one.

    Between the renames there is no table for a moment; if the second one fails, the old table is put back. keep_previous: where the
    old table goes; without it, it is deleted after the swap."""
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    old = keep_previous or f"{path}.old-{uuid.uuid4().hex}"
    fs, (target, new, previous) = _paths(spark, path, staged, old)
    held = exists(spark, path)
    if held and not fs.rename(target, previous):
        raise OSError(f"cannot move {path}")
    try:
        moved = fs.rename(new, target)
    except Exception:
        moved = False
    if not moved:
        if held and not fs.rename(previous, target):
            raise OSError(f"cannot move {staged}, nor {old} back: the old table is there")
        raise OSError(f"cannot move {staged}; {path} is as it was")
    if keep_previous is None and exists(spark, old):
        fs.delete(previous, True)


def rotate(spark: SparkSession, path: str, archive: str, schema: T.StructType) -> None:
    """Archives a table and starts an empty one, as when a salt changes."""
    replace_parquet(spark.createDataFrame([], schema), path, keep_previous=archive)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without them."""
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def export(df: DataFrame, path: str, kind: str) -> None:
    """JSON, CSV with a header even when empty, Parquet or ORC.

    In CSV quotes are doubled, spaces stay, an empty text is a pair of quotes and a null is nothing, as readers.csv takes them."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        flat(df).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue='""').csv(path)
    elif kind in ("json", "parquet", "orc"):
        getattr(w, kind)(path)
    else:
        raise ValueError("kind is csv, json, parquet or orc")


def all_text(df: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """Keys of a JSON column as text columns beside the others."""
    return df.select(*(c for c in df.columns if c != json_col), *(F.get_json_object(F.col(json_col), f"$.{k}").alias(k) for k in keys))


def audit(spark: SparkSession, path: str, event: str, **fields: str | int | float | bool) -> None:
    """Appends one JSON record with a UTC time."""
    row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.lit(event).alias("event"), *(F.lit(v).alias(k) for k, v in fields.items()))
    row.write.mode("append").json(path)
