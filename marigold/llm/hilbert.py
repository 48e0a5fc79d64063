"""Shards in the order of a Hilbert curve over several metadata columns, so that each shard's file holds narrow ranges of all of them.

1. Quantise: a value's cell in its dimension is floor(2**bits * (rows of smaller value) / rows), so that cells hold nearly equal
   numbers of rows wherever values allow it. The numbers come from exact counts of values in a global order; only the at most
   2**bits - 1 smallest values of cells reach the driver.
2. Curve: the cells' bits walk through a table of the curve's turns, made from its rule, which gives the place on the curve.
3. Order and cut: rows are sorted by that place over range partitions whose bounds hold the ties too, so that a hot cell spreads over
   many tasks. Runs of the order are the shards, by law "rows" (counts at most one apart) or "bytes" (sums of sizes near equal: a row
   goes where the middle of its bytes falls).

Everything runs in DataFrame expressions. The sorted rows are a written table; the numbers of rows and bytes before each range
partition, one row for each, are added to places within it.

Defined results: a null dimension counts as smallest; strings as dimensions are ordered by their first 256 code points; rows of one cell
are in the order of `ties`, nulls first; repeated rows are rows of their own; with fewer rows than shards some shards are empty; a null
size counts as none. Rows and extra columns stay; a column named like the result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marigold.lineage import dropped, written

RESULT, LABEL = "hilbert", 256


def turns(dims: int) -> list[int]:
    """The curve's steps: at (entry * dims + direction) * 2**dims + corner, the next (entry * dims + direction) * 2**dims + place.

    Every cube is passed from an entry corner along a direction; its corners are visited in the order of the Gray code, turned so that it
    starts at the entry and ends along the direction."""
    size = 1 << dims
    low = lambda x: next(i for i in range(dims + 1) if not x >> i & 1)  # noqa: E731  number of trailing ones
    right = lambda x, k: (x >> k % dims | x << dims - k % dims) & size - 1
    out = []
    for entry in range(size):
        for direction in range(dims):
            for corner in range(size):
                place, gray = 0, right(corner ^ entry, direction + 1)
                while gray:
                    place ^= gray
                    gray >>= 1
                even = max(0, (place - 1) // 2 * 2)
                onward = 0 if not place else low(place - 1 if place % 2 == 0 else place) % dims
                out.append(((entry ^ right(even ^ even >> 1, dims - direction % dims - 1)) * dims + (direction + onward + 1) % dims) * size + place)
    return out


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """The place on the curve of a cell with these coordinates of `bits` bits each."""
    dims = len(cells)
    if not 0 < dims * bits < 63 or dims > 4:
        raise ValueError("1 to 4 dimensions of together at most 62 bits")
    table, size = F.lit(turns(dims)), 1 << dims
    step, place = F.lit(0), F.lit(0).cast("long")
    for k in reversed(range(bits)):
        corner = sum((F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), i) for i, c in enumerate(cells)), F.lit(0))
        step = F.get(table, step.bitwiseAND(F.lit(-size)) + corner)
        place = F.shiftleft(place, dims).bitwiseOR(step.bitwiseAND(F.lit(size - 1)).cast("long"))
    return place


def in_order(df: DataFrame, keys: Sequence[Column], weight: Column) -> tuple[DataFrame, int, int]:
    """df sorted by the keys over all partitions, nulls first, with the columns _rank (rows before) and _before (sum of weights before);
    the number of rows and the sum of all weights."""
    ranged = df.withColumn("_weight", weight.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    parts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    parts = parts.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "w")), "n", "w")
    total = parts.agg(F.sum("n"), F.sum("w")).first()
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_part", part).join(F.broadcast(parts.drop("n", "w")), "_part")
    placed = placed.withColumn("_rank", F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.withColumn("_before", F.col("_w") + F.coalesce(F.sum("_weight").over(within), F.lit(0))), total[0] or 0, total[1] or 0


def _ordered_value(df: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`")
    return F.left(value, F.lit(LABEL)) if dict(df.dtypes)[name].startswith(("string", "char", "varchar")) else value


def cell_bounds(df: DataFrame, names: Sequence[str], bits: int) -> list[list[tuple[int, object]]]:
    """(cell, smallest value), ascending, of the cells above 0 of each column. One global order serves all columns: first those of the
    first column, then those of the second."""
    values = [_ordered_value(df, c).alias(f"v{i}") for i, c in enumerate(names)]
    df, own = df.select(*values), [f"v{i}" for i in range(len(names))]
    kinds = dict(df.dtypes)
    each = (F.struct(F.lit(i).alias("dim"), *((F.col(c) if i == j else F.lit(None).cast(kinds[c])).alias(c) for j, c in enumerate(own))) for i in range(len(own)))
    counts = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("dim", *own).agg(F.count("*").alias("n"))
    placed, _, weight = in_order(counts, [F.col(c).asc_nulls_first() for c in ("dim", *own)], F.col("n"))
    rows = max(weight // max(len(own), 1), 1)
    cell = F.expr(f"(_before - dim * {rows}) * {1 << bits} div {rows}").cast("int")
    found = placed.where(reduce(or_, (F.col(c).isNotNull() for c in own)))
    found = found.groupBy("dim", cell.alias("cell")).agg(*(F.min(c).alias(c) for c in own)).where("cell > 0").collect()  # less than 2**bits for each column
    dropped(placed)
    return [sorted((r["cell"], r[c]) for r in found if r["dim"] == i) for i, c in enumerate(own)]


def cell_of(value: Column, kind: str, bounds: list[tuple[int, object]]) -> Column:
    """The last cell whose smallest value is not above the value; a tree of comparisons. Null: 0."""

    def between(first: int, last: int) -> Column:
        if first == last:
            return F.lit(bounds[first - 1][0] if first else 0)
        middle = (first + last + 1) // 2
        return F.when(value >= F.lit(bounds[middle - 1][1]).cast(kind), between(middle, last)).otherwise(between(first, middle - 1))

    return between(0, len(bounds))


def shards(df: DataFrame, dimensions: Sequence[str], n_shards: int, *, bits: int = 5, law: str = "rows", size_col: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """df with a struct `hilbert` of curve (the place of the row's cell), shard (from 0) and slot (the row's place in it, from 0)."""
    if law not in ("rows", "bytes") or (law == "bytes" and size_col is None) or n_shards < 1:
        raise ValueError("law: rows, or bytes with size_col; at least one shard")
    kept = [c for c in df.columns if c != RESULT]
    kinds = dict(df.dtypes)
    bounds = cell_bounds(df, dimensions, bits)
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    size = F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)) if law == "bytes" else F.lit(0)
    cells = [cell_of(_ordered_value(df, c), kinds[c], bounds[i]).alias(f"_c{i}") for i, c in enumerate(dimensions)]
    tied = [F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(ties)]
    rows = df.select(whole, *cells, *tied, size.alias("_size"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_curve", curve_index([F.col(f"_c{i}") for i in range(len(dimensions))], bits)).drop(*(f"_c{i}" for i in range(len(dimensions))))
    keys = [F.col(c).asc_nulls_first() for c in ("_curve", *(f"_t{i}" for i in range(len(tied))), "_row")]  # _row: equal rows may be many
    placed, total, weight = in_order(rows, keys, F.col("_size"))
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"CAST(_rank * {n_shards} div {max(total, 1)} AS INT)")).withColumn("_first", F.expr(f"(CAST(shard AS BIGINT) * {total} + {n_shards - 1}) div {n_shards}"))
    else:
        middle = F.expr(f"CAST(CAST(2 * _before + _size AS DECIMAL(38, 0)) * {n_shards} div {max(2 * weight, 1)} AS INT)")
        placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)))
        placed = placed.join(placed.groupBy("shard").agg(F.min("_rank").alias("_first")), "shard")  # one row for each shard
    return placed.select("row.*", F.struct(F.col("_curve").alias("curve"), "shard", (F.col("_rank") - F.col("_first")).alias("slot")).alias(RESULT))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet with a folder for each shard. Rows come as shards() left them: runs of the order, so nothing is shuffled."""
    sharded.withColumn("shard", F.col(f"{RESULT}.shard")).write.partitionBy("shard").parquet(path)


def manifest(spark: SparkSession, path: str, dimensions: Sequence[str]) -> DataFrame:
    """(shard, n_rows, low_<dimension>, high_<dimension>) of written shards: one row each."""
    ends = [f(_ordered_value(df, c)).alias(f"{n}_{c}") for df in [spark.read.parquet(path)] for c in dimensions for n, f in (("low", F.min), ("high", F.max))]
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)


Value = str | int | float | date | datetime | None


def read_shards(spark: SparkSession, path: str, shard_manifest: DataFrame, ranges: dict[str, tuple[Value, Value]]) -> DataFrame:
    """Rows whose dimensions lie in closed ranges (None: open end). Only shards that the manifest cannot rule out are read."""
    rows, left = spark.read.parquet(path), shard_manifest
    for c, (low, high) in ranges.items():
        if low is not None:
            rows, left = rows.where(F.col(f"`{c}`") >= F.lit(low)), left.where(F.col(f"`high_{c}`") >= F.left(F.lit(low), F.lit(LABEL)) if isinstance(low, str) else F.col(f"`high_{c}`") >= F.lit(low))
        if high is not None:
            rows, left = rows.where(F.col(f"`{c}`") <= F.lit(high)), left.where(F.col(f"`low_{c}`") <= F.lit(high))
    return rows.where(F.col("shard").isin([r["shard"] for r in left.select("shard").collect()]))  # as many as shards at most
