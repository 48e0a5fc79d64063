"""A content-addressed store as table operations: upserts, deletes, compaction, tagging and change history.

Every operation is DataFrame to DataFrame; marigold.sources.sinks publishes the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last in this order."""
    w = Window.partitionBy(*keys).orderBy(*((F.col(c) if isinstance(c, str) else c).desc() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ()) -> DataFrame:
    """keys, value, status: base with the batch applied; status new, updated or same. A key twice in the batch: the last wins."""
    last = keep_last(batch, keys, order) if order else batch.dropDuplicates(list(keys))
    old = base.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_base"))
    new = last.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_batch"))
    joined = old.join(new, list(keys), "full")
    status = F.when(F.col("_in_base").isNull(), "new").when(F.col("_in_batch").isNull() | F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("updated")
    return joined.select(*keys, F.when(F.col("_in_batch"), F.col("_new")).otherwise(F.col("_old")).alias(value), status.alias("status"))


def upsert_counts(applied: DataFrame) -> DataFrame:
    return applied.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("new", "updated", "same")))


def append_edges(base: DataFrame, batch: DataFrame, keys: Sequence[str] = ("from_pid", "to_pid", "relation")) -> DataFrame:
    """base and the batch's edges that it lacks, each once."""
    fresh = batch.dropDuplicates(list(keys)).join(base, list(keys), "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def purge(df: DataFrame, id_col: str, ids: Sequence[int]) -> DataFrame:
    """Rows but those with these ids; rows with a null id stay."""
    return df.where(~F.coalesce(F.col(id_col).isin(*ids), F.lit(False))) if ids else df


def within_ids(df: DataFrame, id_col: str, ids: Sequence[int] | None) -> DataFrame:
    """Rows with these ids; an empty set gives no rows, None all."""
    return df if ids is None else df.where(F.col(id_col).isin(*ids)) if ids else df.where(F.lit(False))


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def change_history(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old_value, new_value): one row per field that differs."""
    old = before.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value")) for f in fields))).alias("o")).select(key, "o.*")
    new = after.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("new_value")) for f in fields))).alias("n")).select(key, "n.*")
    return old.join(new, [key, "field"]).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def compact(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(cid, payload): identifiers recomputed from the payloads, each payload once."""
    from marigold.functions.hashing import cid_v1

    return raw.select(cid_v1(F.col(payload)).alias("cid"), payload).dropDuplicates(["cid"])


def tag(df: DataFrame, condition: Column, column: str, value: str, *, dry_run: bool = False) -> DataFrame:
    """Sets a tag on matching rows; with dry_run, only the matching rows, unchanged."""
    return df.where(condition) if dry_run else df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column) if column in df.columns else F.lit(None).cast("string")))


def stamped(df: DataFrame, **provenance: str) -> DataFrame:
    return df.select("*", *(F.lit(v).alias(f"_{k}") for k, v in provenance.items()))


def identifiers(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(known_id, key): distinct pairs of every identifier-like column."""
    ids = F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("known_id")
    return df.select(ids, F.col(key)).where("known_id IS NOT NULL AND known_id <> ''").distinct()


def expanded_queries(base: Sequence[str], terms: Sequence[str] = (), sweep: bool = False) -> list[tuple[str, bool]]:
    """(query, expanded): the queries, each with each term, each with a-z and 0-9; the first of equal ones stays."""
    made = [(q, False) for q in base] + [(f"{q} {t}", True) for q in base for t in terms]
    if sweep:
        made += [(f"{q} {c}", True) for q in base for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    kept: dict[str, bool] = {}
    for q, e in made:
        kept.setdefault(q, e)
    return list(kept.items())
