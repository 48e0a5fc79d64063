"""Entities, ratings and their lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigold.lineage import written

#: Orders of the entity list by name; each ends in a unique key.
SORTS = {
    "name": (("name", True),),
    "name-desc": (("name", False),),
    "category": (("category", True), ("name", True)),
    "rating_count": (("rating_count", False), ("name", True)),
    "updated": (("updated_at", False),),
}


def entity_list(entities: DataFrame, ratings: DataFrame, *, search: str | None = None, category: str | None = None, sort: str = "name", limit: int = 50, offset: int = 0) -> DataFrame:
    """Entities with rating count and mean confidence, those without ratings included; ratings are summed before the join."""
    if search:
        entities = entities.where(F.col("name").ilike(f"%{search}%") | F.col("category").ilike(f"%{search}%"))
    if category:
        entities = entities.where(F.col("category") == category)
    summed = ratings.groupBy("entity_id").agg(F.count("*").alias("rating_count"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    listed = entities.join(summed, entities["id"] == summed["entity_id"], "left").drop("entity_id").withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in SORTS.get(sort, SORTS["name"])]
    return listed.orderBy(*order, "id").offset(offset).limit(limit)


def typing_summary(entities: DataFrame, judgments: DataFrame, types: DataFrame) -> DataFrame:
    """Judgments by entity, system and type; entities without any have one row of nulls and zero."""
    joined = entities.join(judgments, "entity_id", "left").join(types, "type_id", "left")
    return joined.groupBy("entity_id", "entity_name", "system", "type_code").agg(F.count("judgment_id").alias("total_judgments"), F.avg("confidence").alias("average_confidence"), F.max("updated_at").alias("last_typed"))


def rater_summary(users: DataFrame, judgments: DataFrame) -> DataFrame:
    """Active users with what they judged."""
    joined = users.where("is_active").join(judgments, "rater_id", "left")
    return joined.groupBy("rater_id", "username").agg(
        F.count("judgment_id").alias("total_judgments"), F.avg("confidence").alias("average_confidence"), F.countDistinct("entity_id").alias("entities_typed"),
        F.countDistinct("session_id").alias("sessions_participated"), F.min("created_at").alias("first_judgment"), F.max("created_at").alias("last_judgment"),
    )


def with_types(entities: DataFrame, links: DataFrame, types: DataFrame) -> DataFrame:
    """Entities with the list of their types: one join instead of one query per row."""
    listed = links.join(types, "type_id").groupBy("entity_id").agg(F.array_sort(F.collect_set("type_code")).alias("types"))
    return entities.join(listed, "entity_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def latest(df: DataFrame, entity: str, time: str, k: int, tie: str) -> DataFrame:
    """The k newest rows of each entity."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): one row per table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def balanced_sample(df: DataFrame, axis: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows of each axis value, drawn by a hash of seed and id."""
    from pyspark.sql import Window

    w = Window.partitionBy(axis).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def missing_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set but not found: what a foreign key would reject."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, n): how many values break each range check."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (~F.col(c).between(lo, hi)).alias("bad")) for c, (lo, hi) in bounds.items()))).alias("x")).select("x.*")
    return cells.groupBy("column").agg(F.count(F.when(F.col("bad"), 1)).alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a unique constraint would reject, and how often they occur."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """df with each row's place in an order, from 0: a sort by ranges, and one offset per partition, no single task."""
    ids = written(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "numbered")
    sizes = ids.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))  # a row per partition
    return ids.join(before, "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of equal place in two tables side by side; the longer table's rest goes."""
    return numbered(left, left_order).join(numbered(right, right_order), "position")
