"""Blocks of vectors that meet block by block: each pair of blocks is a matrix product.

A block is one row of a written table: ids, and the vectors end to end. Blocks of two tables meet by a Cartesian product of their
partitions, which reads both tables and shuffles and writes nothing, however many pairs of blocks there are. Products of single precision
only say which pairs may count; what counts is decided by dot products in double precision, in the order of the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.lineage import written

#: Values of a block at most; rows of a product; pairs whose exact product is taken at once; components beyond which squares may overflow.
BLOCK_VALUES, STEP, EXACT, LARGEST = 1 << 19, 2048, 1 << 14, 1e100


def fine(v: Column, dimension: int) -> Column:
    """Whether a vector has this length and numbers alone that can be squared."""
    return F.coalesce((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > LARGEST)), F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def block() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, x = (whole.column(c).chunk(0) for c in ("id", "v"))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.asarray(x.flatten()).tobytes()], pa.binary())], ["ids", "x"])

    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, rows - n)
            batch, n = batch.slice(piece.num_rows), n + piece.num_rows
            held.append(piece)
            if n == rows:
                yield block()
                held, n = [], 0
    if held:
        yield block()


def packed(df: DataFrame, dimension: int, name: str, *, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """(ids, x): the rows of each partition in blocks of `rows` rows, fewer if vectors are long. All vectors are fine()."""
    kinds = dict(df.dtypes)
    width = "float" if kinds[vector_col] == "array<float>" else "double"
    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{width}>").alias("v"))
    return written(slim.mapInArrow(partial(_packed, rows=max(16, min(rows, BLOCK_VALUES // max(1, dimension)))), f"ids array<{kinds[id_col]}>, x binary"), name, heavy=True)


def matrix(data: pa.Scalar, rows: int, dimension: int) -> np.ndarray:
    """The vectors of a block in doubles, from floats or doubles."""
    held = data.as_buffer()
    return np.frombuffer(held, np.float32 if held.size == 4 * rows * dimension else np.float64).reshape(rows, dimension).astype(np.float64)


def slack(dimension: int) -> float:
    """What a cosine by single precision may be off."""
    return 1e-6 + (dimension + 4) * 1.2e-7


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows of x and y, components added in their order, as an aggregate over an array does."""
    out = np.empty(len(x))
    for a in range(0, len(x), EXACT):
        out[a : a + EXACT] = np.cumsum(x[a : a + EXACT] * y[a : a + EXACT], axis=1)[:, -1]
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round(): half away from zero, by the decimal digits that a double is written with."""
    out = np.round(x, digits)
    scaled = np.abs(x) * 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


class Side:
    """A block with its norms and unit vectors in single precision."""

    def __init__(self, ids: pa.Array, x: np.ndarray) -> None:
        self.ids, self.keys, self.x = ids, ids.to_numpy(zero_copy_only=False), x
        self.norms = np.sqrt(dots(x, x))
        self.unit = (x / np.where(self.norms > 0, self.norms, 1)[:, None]).astype(np.float32)

    @classmethod
    def of(cls, whole: Side, rows: np.ndarray) -> Side:
        """Some rows of a block, for products: ids and vectors in doubles stay with the whole one."""
        side = cls.__new__(cls)
        side.norms, side.unit = (whole.norms, whole.unit) if len(rows) == len(whole.norms) else (whole.norms[rows], whole.unit[rows])
        return side

    def products(self, other: Side, rows: slice, columns: slice) -> np.ndarray:
        """About the scores of rows of this block with rows of the other one."""
        s = self.unit[rows] @ other.unit[columns].T
        n, m = self.norms[rows], other.norms[columns]
        if n.size and m.size and n.min() * m.min() < 1e-2:  # epsilon matters beside such norms
            scale = np.outer(n, m)
            s *= scale / (scale + vectors.EPSILON)
        return s


class Nearest:
    """The k best of a block of queries among the blocks met so far; equal scores by id."""

    def __init__(self, asked: Side, k: int, digits: int) -> None:
        self.asked, self.k, self.digits = asked, k, digits
        self.order = np.argsort(asked.keys, kind="stable")
        self.least = np.full(len(asked.keys), -np.inf)  # of a score by single precision that may count
        self.rows, self.keys, self.scores = np.zeros(0, np.int64), asked.keys[:0], np.zeros(0)

    def meet(self, other: Side) -> None:
        off, n = slack(self.asked.x.shape[1]), len(self.least)
        found = []
        for a in range(0, len(other.keys), STEP):
            s = self.asked.products(other, slice(None), slice(a, a + STEP))
            own = other.keys[a : a + STEP]
            first, last = (np.searchsorted(self.asked.keys[self.order], own, side) for side in ("left", "right"))
            for c in np.flatnonzero(first < last).tolist():
                s[self.order[first[c] : last[c]], c] = -np.inf  # no row is near to its own id
            if s.shape[1] >= self.k and np.isneginf(self.least).any():
                self.least = np.maximum(self.least, np.partition(s, -self.k, axis=1)[:, -self.k] - 2 * off - 10.0**-self.digits)
            at = np.flatnonzero((s >= self.least.astype(np.float32)[:, None]) & (s > -np.inf))
            found.append((at // s.shape[1], at % s.shape[1] + a))
        row, column = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(row):
            return
        score = np.empty(len(row))
        for a in range(0, len(row), EXACT):
            i, j = row[a : a + EXACT], column[a : a + EXACT]
            score[a : a + EXACT] = dots(self.asked.x[i], other.x[j]) / (other.norms[j] * self.asked.norms[i] + vectors.EPSILON)
        rows, keys, scores = np.concatenate([self.rows, row]), np.concatenate([self.keys, other.keys[column]]), np.concatenate([self.scores, rounded(score, self.digits)])
        order = np.lexsort((np.unique(keys, return_inverse=True)[1], -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.least[rows[place == self.k - 1]] = np.maximum(self.least[rows[place == self.k - 1]], scores[full] - off - 2 * 10.0**-self.digits)
        self.rows, self.keys, self.scores = rows[place < self.k], keys[kept], scores[kept]

    def result(self) -> pa.RecordBatch:
        asked = self.asked.ids.take(pa.array(self.rows))
        return pa.RecordBatch.from_arrays([asked, pa.array(self.keys, self.kind), pa.array(self.scores)], ["query_id", "id", "score"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int, digits: int, dimension: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): the k best of each query among the blocks of a task. Blocks of one block of queries come in a row."""
    block, best = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            sides = lambda ids, x: Side(own := batch.column(ids)[i].values, matrix(batch.column(x)[i], len(own), dimension))  # noqa: B023, E731
            if batch.column("_b")[i].as_py() != block or best is None:
                if best is not None:
                    yield best.result()
                block, best = batch.column("_b")[i].as_py(), Nearest(sides("_q", "_qx"), k, digits)
                best.kind = batch.column("_r")[i].values.type
            best.meet(sides("_r", "_rx"))
    if best is not None:
        yield best.result()


def nearest(corpus: DataFrame, asked: DataFrame, k: int, digits: int, dimension: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each task for each query, of blocks of packed()."""
    (q,), (c,) = (([t for n, t in d.dtypes if n == "ids"]) for d in (asked, corpus))
    left = asked.select(F.monotonically_increasing_id().alias("_b"), F.col("ids").alias("_q"), F.col("x").alias("_qx"))
    met = left.hint("shuffle_replicate_nl").crossJoin(corpus.select(F.col("ids").alias("_r"), F.col("x").alias("_rx")))
    inner = lambda t: t.removeprefix("array<").removesuffix(">")
    return met.mapInArrow(partial(_nearest, k=k, digits=digits, dimension=dimension), f"query_id {inner(q)}, id {inner(c)}, score double")
