"""Exact top-k by inner product over a vector-approximation file.

Equal vectors are one class, with as many of its smallest ids as results can name. Classes are dealt to blocks, and each block becomes
one row of the approximation file, a written table: a component is one of 2**8 cells of equal width between the smallest and largest
component of its dimension in the block, one byte each.

1. Scan: only approximations meet the query blocks. The middle of a vector's cells gives a score, half the cells' width its largest
   error: a lower and an upper bound. A vector stays a candidate of a query while its upper bound reaches the k-th largest lower
   bound, first of the block, then of all blocks.
2. Read: exact vectors are fetched in order of their bounds, in two waves. The k candidates of largest upper bound come first. Their
   k-th exact score makes certain that only candidates whose upper bound reaches it can still matter; these are the second wave.

Query blocks and candidate blocks meet pair by pair, so memory does not grow with the table. Vectors that are null or hold null or
non-finite components take no part, as queries or candidates, and neither do null ids. Vectors of unequal lengths count as padded by
zeros. Candidates of the query's own id take no part; repeated ids are rows of their own. Equal query rows are one query; query rows
of one id and different vectors are queries of their own, whose results carry the same query_id.

Scores are exact: in doubles while all sums stay below 2**53, in Python integers beyond. Bounds take the rounding of doubles into
account. A returned score beyond 64 bits, which the result cannot hold, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigold.lineage import written

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
_CELLS, _EXACT, _ROUND = 256, 1 << 53, 2.0**-52
_MOST = 10**38 - 1


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None, scale: int = 0) -> np.ndarray:
    """Rows of components, padded by zeros, times 2**scale."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    lengths = np.asarray(arr.value_lengths())
    out = np.zeros((len(arr), int(lengths.max(initial=1)) if width is None else width))
    row = np.repeat(np.arange(len(arr)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.ldexp(np.asarray(arr.flatten()), scale)
    return out


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each component (uint8), and the lowest bound and the cells' width of each dimension."""
    low = x.min(0)
    width = (x.max(0) - low) / _CELLS
    codes = np.divide(x - low, width, out=np.zeros_like(x), where=width > 0)
    return np.clip(np.floor(codes), 0, _CELLS - 1).astype(np.uint8), low, width


def bounds(q: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of the cells' middles, largest error): (queries, vectors) and (queries, 1)."""
    middle = q @ (low + (codes + 0.5) * width).T
    size = np.abs(q)
    most = np.maximum(np.abs(low), np.abs(low + _CELLS * width))
    error = size @ (0.5 * width) + (size @ most) * ((q.shape[1] + 16) * 4 * _ROUND) + 2.0**-1000
    return middle, error[:, None]


def _approximated(table: pa.Table, scale: int) -> pa.Table:
    """A block of classes as one row of the approximation file."""
    x = _matrix(table["v"], scale=scale)
    codes, low, width = cells(x)
    columns = [np.asarray(table["cid"]).astype(np.int64), np.asarray(table["least"]).astype(np.int64), np.asarray(table["several"]).astype(bool), codes, low, width]
    return pa.Table.from_arrays([table["cb"][:1], *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["cb", "cids", "least", "several", "codes", "low", "width"])


_FILE = "cb long, cids binary, least binary, several binary, codes binary, low binary, width binary"
_SCANNED = pa.schema([("qk", pa.int64()), ("query_id", pa.int64()), ("cid", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64()), ("leading", pa.bool_())])


def _scanned(queries: pa.Table, block: pa.Table, k: int, scale: int) -> pa.Table:
    """Candidates of each query in a block: those whose upper bound reaches the block's k-th largest lower bound."""
    if not queries.num_rows or not block.num_rows:
        return _SCANNED.empty_table()
    read = lambda name, kind: np.frombuffer(block[name][0].as_buffer(), kind)
    cids, least, several, low, width = (read(n, t) for n, t in (("cids", np.int64), ("least", np.int64), ("several", bool), ("low", np.float64), ("width", np.float64)))
    codes = read("codes", np.uint8).reshape(len(cids), len(low))
    keys, ids = np.asarray(queries["qk"]), np.asarray(queries["id"])
    q = _matrix(queries["v"], max(len(low), *queries["v"].combine_chunks().value_lengths().to_pylist()), scale)[:, : len(low)]
    out = []
    for a in range(0, len(q), 64):
        middle, error = bounds(q[a : a + 64], codes, low, width)
        middle[(ids[a : a + 64, None] == least) & ~several] = -np.inf  # classes of the query's own id alone
        kth = np.partition(middle, -k, axis=1)[:, -k] if len(cids) > k else np.full(len(middle), -np.inf)
        row, column = np.nonzero((middle + 2 * error >= kth[:, None]) & (middle > -np.inf))
        m, e = middle[row, column], error[row, 0]
        out.append((keys[a + row], ids[a + row], cids[column], m - e, m + e, m >= kth[row]))
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_SCANNED)


def exact_scores(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Inner products of paired rows of multiples of 1/256, in units of 1/65536, as integers."""
    if q.shape[1] * float(np.ceil(np.abs(q).max(initial=0.0))) * float(np.ceil(np.abs(x).max(initial=0.0))) * 65536 < _EXACT:
        return np.einsum("ij,ij->i", q * 256, x * 256).astype(np.int64).tolist()

    def whole(row: np.ndarray) -> list[int]:
        return [(n << 8) // d for n, d in map(float.as_integer_ratio, row.tolist())]

    return [sum(map(int.__mul__, whole(a), whole(b))) for a, b in zip(q, x, strict=True)]


def _read(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(qk, query_id, vec_id, score, near): exact scores of candidates, one row for each of their ids but the query's own. near: the
    score as a double in the units of the bounds, a little lowered."""
    for whole in batches:
        for first in range(0, whole.num_rows, 1024):
            batch = whole.slice(first, 1024)
            width = max(1, *(max(batch.column(c).value_lengths().to_pylist()) for c in ("q", "v")))
            scores = exact_scores(_matrix(batch.column("q"), width), _matrix(batch.column("v"), width))
            rows = []
            for qk, own, ids, score in zip(*(batch.column(c).to_pylist() for c in ("qk", "query_id", "ids")), scores, strict=True):
                top = score.bit_length() - 60  # 60 bits of the score, times a power of two
                near = np.ldexp(float(score >> top if top > 0 else score), max(top, 0) - 16 + scale)
                near -= abs(near) * 2.0**-50
                rows += [(qk, own, i, max(-_MOST, min(_MOST, score)), near) for i in ids if i != own]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["qk", "query_id", "vec_id", "score", "near"])


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best rows of `vectors` but rows of its own id.

    Both have the columns id_col and vector_col. The score is the inner product of the components times 256, rounded down."""

    def usable(df: DataFrame) -> DataFrame:
        v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
        fine = v.isNotNull() & i.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        floored = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < float(_EXACT >> 8), F.floor(x.cast("double") * 256) / F.lit(256.0)).otherwise(x.cast("double")))  # larger doubles are multiples of 1/256
        return df.where(F.coalesce(fine, F.lit(False))).select(i.cast("long").alias("id"), floored.alias("v"))

    def exponent(df: DataFrame) -> int:
        """Of the power of two that scales all components to at most 1."""
        most = df.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0.0
        return int(np.frexp(most)[1])

    own = Window.partitionBy("v", "id").orderBy("id")
    few = usable(vectors).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k)
    few = few.withColumn("d", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("d") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id())  # at most k * (k + 1) ids each
    classes = written(classes, "classes")
    q = written(usable(queries).distinct().withColumn("qk", F.monotonically_increasing_id()), "queries")
    blocks = {n: max(1, -(-df.count() // size)) for n, df, size in (("c", classes, CANDIDATE_BLOCK), ("q", q, QUERY_BLOCK))}
    scales = {"c": -exponent(classes), "q": -exponent(q)}
    whole = sum(scales.values())
    dealt = classes.select(F.pmod(F.xxhash64("cid"), F.lit(blocks["c"])).alias("cb"), "cid", F.element_at("ids", 1).alias("least"), (F.element_at("ids", 1) != F.element_at("ids", -1)).alias("several"), "v")
    file = written(dealt.groupBy("cb").applyInArrow(lambda table: _approximated(table, scales["c"]), _FILE), "approximations")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[n] - 1).cast("long")))
    left = q.select(F.pmod(F.xxhash64("qk"), F.lit(blocks["q"])).alias("qb"), every("c").alias("cb"), "qk", "id", "v")
    right = file.select(every("q").alias("qb"), "*")
    scanned = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(partial(_scanned, k=k, scale=scales["q"]), "qk long, query_id long, cid long, lower double, upper double, leading boolean")
    scanned = written(scanned, "scanned")

    def kth(df: DataFrame, column: str) -> DataFrame:
        """(qk, kth): the k-th largest value of each query."""
        best = Window.partitionBy("qk").orderBy(F.desc(column))
        return df.select("qk", column).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).where(F.col("r") == k).select("qk", F.col(column).alias("kth"))

    def read(some: DataFrame) -> DataFrame:
        met = some.select("qk", "query_id", "cid").join(classes.select("cid", "ids", "v"), "cid").join(q.select("qk", F.col("v").alias("q")), "qk")
        return met.select("qk", "query_id", "ids", "q", "v").mapInArrow(partial(_read, scale=whole), "qk long, query_id long, vec_id long, score decimal(38,0), near double")

    reach = F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))
    left = scanned.join(kth(scanned.where("leading"), "lower"), "qk", "left").where(reach).drop("kth")
    order = Window.partitionBy("qk").orderBy(F.desc("upper"), "cid")
    first = written(left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("qk", "query_id", "cid"), "first")
    one = written(read(first), "scores")
    other = left.join(first.select("qk", "cid"), ["qk", "cid"], "left_anti").join(kth(one, "near"), "qk", "left").where(reach)
    best = Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    ranked = one.unionByName(read(other)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    fits = F.abs("score") < F.lit(str(1 << 63)).cast("decimal(38,0)")
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
