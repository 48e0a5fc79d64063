"""Pairs of vectors above a cosine threshold: an exact join, pruned by pivots.

Equal vectors are one class, so that a hot group of copies is one row. Pivots are unit vectors near the centres of a bounded sample;
a class's home is the pivot of largest inner product. The distance of two unit vectors of different homes is at least the sum of both
distances to the plane halfway between their homes' pivots. Rows of a home are packed in blocks, range-partitioned, and a block keeps the
smallest distance of its rows to the plane of each other pivot: two blocks meet only if these sums leave room for a pair, and then only
those of their rows that do. Pivots decide the cost alone. Vectors without clusters are near most planes, and all blocks then compare, as
in any exact method.

Blocks meet by a Cartesian product of the partitions of one written table (vector_blocks): disk holds each vector once, however many
blocks it meets. Pairs are not written; who only counts links does not make them. A hot cell is many blocks, and no task holds more than
one partition of blocks.

Rows with a null id, a null or non-finite vector or one of another length than most take no part; zero vectors have no near ones.
Repeated ids with different vectors are members of several classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.lineage import batches_of, dropped, written
from marigold.operators.ann import _fine, bounded_sample, lloyd
from marigold.operators.stats import dimension_mode
from marigold.operators.vector_blocks import Side, matrix, slack

#: Sample rows that pivots come from, and pivots, at most; components of a block; rows of a product, and exact products at once.
SAMPLE, MOST_PIVOTS, BLOCK_VALUES = 8192, 256, 1 << 19
STEP, EXACT = 1024, 1 << 14
SLACK = 1e-5


def classes(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, class, v): the usable rows, with the smallest id of an equal vector and the vector in doubles. A written table."""
    mode = dimension_mode(df, vector_col, "larger").first()
    v = F.col(vector_col)
    fine = _fine(v, int(mode["dimension"])) if mode is not None else F.lit(False)
    rows = df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    first = rows.groupBy("v").agg(F.min("id").alias("class"))
    return written(rows.join(first, "v").select("id", "class", "v"), "classes")


def _cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """(cell, guest, id, v): a row for a vector's home and for each cell where it is a guest, of (id, v) with v not zero."""
    apart = np.maximum(np.linalg.norm(pivots[:, None] - pivots[None], axis=2), 1e-12)
    for whole in batches:
        for b in (whole.slice(a, 2048) for a in range(0, whole.num_rows, 2048)):
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            dots = x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True)
            home = dots.argmax(1)
            away = (dots[np.arange(len(x)), home][:, None] - dots) / apart[home]
            row, cell = np.nonzero((away <= reach) | (np.arange(len(pivots)) == home[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cell != home[row]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["cell", "guest", "id", "v"])


def _apart(pivots: np.ndarray) -> np.ndarray:
    """Distances of pivots; between equal ones there is no plane, and none is far from it."""
    apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
    return np.where(apart < 1e-6, np.inf, apart)


def _blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one cell as one row each, with the smallest distance of the rows to the plane between their pivot and each other
    one. Vectors that single precision holds are kept in it. Rows come in order of their cells."""
    apart = _apart(pivots)
    for whole in batches:
        cell = np.asarray(whole.column("cell"))
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), whole.num_rows] if whole.num_rows else [0]
        size = max(16, BLOCK_VALUES // max(1, len(whole.column("v")[0]))) if whole.num_rows else 16
        for first, last in ((a, min(a + size, end)) for start, end in zip(cuts, cuts[1:], strict=False) for a in range(start, end, size)):
            b = whole.slice(first, last - first)
            x, ids = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1), b.column("id")
            dots = x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True)
            away = ((dots[:, cell[first]][:, None] - dots) / apart[cell[first]]).min(0)
            with np.errstate(over="ignore"):
                narrow = x.astype(np.float32)
            kept = narrow if np.array_equal(narrow.astype(np.float64), x) else x
            columns = [b.column("cell").slice(0, 1), pa.array([away.tolist()], pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([kept.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "away", "ids", "x"])


def _side(batch: pa.RecordBatch, i: int, n: str, dimension: int) -> Side:
    ids = batch.column(f"ids{n}")[i].values
    return Side(ids, matrix(batch.column(f"x{n}")[i], len(ids), dimension))


def _close(left: Side, right: Side, p: np.ndarray, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either side, of cells with the pivots p and q, that may have a partner on the other one."""
    apart = np.linalg.norm(p - q)
    if apart < 1e-6:
        return np.arange(len(left.x)), np.arange(len(right.x))
    plane = (p - q) / apart
    a, b = left.x @ plane / left.norms, right.x @ -plane / right.norms
    return np.flatnonzero(a + b.min() <= reach), np.flatnonzero(b + a.min() <= reach)


def _found(left: Side, right: Side, same: bool, some: tuple[np.ndarray, np.ndarray], threshold: float, digits: int, scored: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(row, column, score): pairs of two blocks at or above the threshold, by steps; of a block with itself each pair once. Without
    `scored`, only those that single precision leaves open are computed in doubles, and there are no scores."""
    off = slack(left.x.shape[1]) + 10.0**-digits
    low, high = np.float32(threshold - off), np.float32(threshold + off)
    rows, columns = some
    part = Side.of(right, columns)
    for a in range(0, len(rows), STEP):
        own = rows[a : a + STEP]
        s = Side.of(left, own).products(part, slice(None), slice(None))
        at = np.flatnonzero(s >= low)
        row, column = own[at // s.shape[1]], columns[at % s.shape[1]]
        near = s.reshape(-1)[at]
        keep = row < column if same else left.keys[row] != right.keys[column]
        if same:
            keep &= left.keys[row] != right.keys[column]
        row, column, near = row[keep], column[keep], near[keep]
        sure = np.zeros(len(row), bool) if scored else near > high
        score = np.full(len(row), np.inf)
        open_ = np.flatnonzero(~sure)
        for b in range(0, len(open_), EXACT):
            e = open_[b : b + EXACT]
            i, j = row[e], column[e]
            score[e] = np.round(np.einsum("ij,ij->i", left.x[i], right.x[j]) / (left.norms[i] * right.norms[j] + vectors.EPSILON), digits)
        keep = score >= threshold
        yield row[keep], column[keep], score[keep] if scored else None


def _met(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, reach: float, threshold: float, digits: int) -> Iterator[pa.RecordBatch]:
    """(a, b, score): pairs of two blocks' vectors, the smaller id first."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (_side(batch, i, n, pivots.shape[1]) for n in ("", "_b"))
            p, q = (pivots[batch.column(c)[i].as_py()] for c in ("cell", "cell_b"))
            same = batch.column("block")[i].as_py() == batch.column("block_b")[i].as_py()
            for row, column, score in _found(left, right, same, _close(left, right, p, q, reach), threshold, digits, True):
                x, y = left.keys[row], right.keys[column]
                turned = x > y
                a, b = np.where(turned, y, x), np.where(turned, x, y)
                yield pa.RecordBatch.from_arrays([pa.array(a, left.ids.type), pa.array(b, left.ids.type), pa.array(score)], ["a", "b", "score"])


def _counted(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, reach: float, threshold: float, digits: int) -> Iterator[pa.RecordBatch]:
    """(class, n): how many pairs the vectors of the task's blocks have, a number for each block's row."""
    held: dict[int, tuple[pa.Array, np.ndarray]] = {}  # one partition's blocks, and the present one of the other
    present = None

    def row_of(block: int) -> pa.RecordBatch:
        ids, n = held.pop(block)
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(n > 0)), pa.array(n[n > 0])], ["class", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (_side(batch, i, n, pivots.shape[1]) for n in ("", "_b"))
            p, q = (pivots[batch.column(c)[i].as_py()] for c in ("cell", "cell_b"))
            one, two = (batch.column(c)[i].as_py() for c in ("block", "block_b"))
            if present not in (None, one):
                yield row_of(present)
            present = one
            for block, side in ((one, left), (two, right)):
                if block not in held:
                    held[block] = side.ids, np.zeros(len(side.keys), np.int64)
            for row, column, _ in _found(left, right, one == two, _close(left, right, p, q, reach), threshold, digits, False):
                for block, at in ((one, row), (two, column)):
                    held[block][1][:] += np.bincount(at, minlength=len(held[block][1]))
    for block in list(held):
        yield row_of(block)


def _meeting(held: DataFrame, threshold: float, digits: int) -> tuple[DataFrame, dict] | None:
    """Pairs of blocks that may hold near vectors, and what a step over them needs; None without vectors."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0, 1 at most")
    kind = dict(held.dtypes)["class"]
    own = held.where(F.col("id") == F.col("class")).dropDuplicates(["class", "v"]).select("class", "v")
    own = written(own.where(vectors.norm(F.col("v")) > 0), "distinct")
    sample = np.array([r.v for r in bounded_sample(own, SAMPLE, "class").select("v").collect()])  # SAMPLE rows at most
    if not len(sample):
        return None
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    pivots = lloyd(unit, min(MOST_PIVOTS, math.isqrt(len(unit))), 8, 7)
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    reach = math.sqrt(max(0.0, 2 - 2 * (threshold - 10.0**-digits))) + SLACK
    cells = own.mapInArrow(partial(_cells, pivots=pivots, reach=-1.0), f"cell int, guest boolean, id {kind}, v array<double>").drop("guest")  # homes alone
    keys = ["cell", F.xxhash64("id"), "id"]
    blocks = cells.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_blocks, pivots=pivots), f"cell int, away array<double>, ids array<{kind}>, x binary")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", heavy=True)
    dropped(own)
    other = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns))
    distance = F.get("away", F.col("cell_b")) + F.get("away_b", F.col("cell"))
    met = blocks.hint("shuffle_replicate_nl").join(other, (F.col("block") <= F.col("block_b")) & ((F.col("cell") == F.col("cell_b")) | (distance <= reach)))
    return met.select("block", "cell", "ids", "x", "block_b", "cell_b", "ids_b", "x_b"), {"pivots": pivots, "reach": reach, "threshold": threshold, "digits": digits}


def near_pairs(held: DataFrame, threshold: float, *, digits: int = 6) -> DataFrame:
    """(a, b, score), a < b, once for each pair of classes of classes() whose rounded cosine reaches the threshold, above 0. The pairs are
    made when they are read, and are not written."""
    kind, meeting = dict(held.dtypes)["class"], _meeting(held, threshold, digits)
    if meeting is None:
        return held.sparkSession.createDataFrame([], f"a {kind}, b {kind}, score double")
    met, known = meeting
    return met.mapInArrow(partial(_met, **known), f"a {kind}, b {kind}, score double")


def near_counts(held: DataFrame, threshold: float, *, digits: int = 6) -> DataFrame:
    """(id, class, n_links): links() of near_pairs(), without the pairs: each task counts."""
    kind, meeting = dict(held.dtypes)["class"], _meeting(held, threshold, digits)
    if meeting is None:
        return held.select("id", "class", F.lit(0).cast("long").alias("n_links"))
    met, known = meeting
    counted = met.mapInArrow(partial(_counted, **known), f"class {kind}, n long").groupBy("class").agg(F.sum("n").alias("n_links"))
    with batches_of(held.sparkSession, 8 << 20):
        return _with_links(held, written(counted, "counts"))


def _with_links(held: DataFrame, counted: DataFrame) -> DataFrame:
    return held.select("id", "class").join(counted, "class", "left").select("id", "class", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def links(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class, n_links): each row's class and how many other classes are linked with it."""
    both = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    return _with_links(held, both.groupBy("class").agg(F.count("*").alias("n_links")))
