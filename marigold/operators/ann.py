"""Approximate nearest neighbours by an inverted file of product-quantised codes.

Fit: coarse centroids, by cosine k-means in one task, and codebooks of residuals come from a sample whose size is a parameter (the rows of smallest
hash of their id), so the driver holds a model of bounded size whatever the table's. How many lists a query has to probe follows from
the sample, too: the fewest that hold a stated share of the exact neighbours of some sample rows. Vectors without clusters need most
lists, clustered ones few. Build: every row is assigned to its nearest
centroid's list and coded as one byte for each part of its residual. The index is two written tables with a folder for each list: codes
in blocks, and rows with their exact vectors. Search: a query scans the codes of its nearest lists alone (partition pruning), in blocks, which
meet blocks of queries by a Cartesian product: codes are decoded and multiplied, and a task passes on a query's best ones alone. The best
candidates' exact vectors give the scores.

A list may hold a third of all rows: rows are range-partitioned by list and hash, so that many tasks write and scan its blocks.

Rows whose vector is null, of another length than the model's or not finite take no part; zero vectors score 0. Rows of the query's own
id take no part in its result; ties end in the id. operators.search.similar gives the exact answer to the same question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marigold.functions import vectors
from marigold.lineage import dropped, written
from marigold.operators import stats
from marigold.operators.vector_blocks import matrix, packed
from marigold.sources.readers import parquet_or_empty

#: Rows that fit the model at most, lists at most, and rows that one block of codes holds.
SAMPLE, MOST_LISTS, BLOCK = 65_536, 2048, 4096
#: Sample rows among which neighbours are sought for the number of probes, and how many of them ask.
TUNED, ASKING = 8192, 256
#: Queries at most in a block that meets blocks of codes.
PACK = 2048


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of the rows of x, by squared distance; a centre without rows stays where it is."""
    rnd = np.random.default_rng(seed)
    centres = x[rnd.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Model:
    """centroids: (lists, dimension). codebooks: (parts, at most 256, ceil(dimension / parts)), residuals padded by zeros. probes: lists
    that a query scans."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int = 1

    def split(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        padded = np.zeros((len(x), parts * width), np.float32)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), parts, width)

    def assigned(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty(len(unit), np.int32)
        for a in range(0, len(unit), 1024):
            out[a : a + 1024] = (np.square(self.centroids).sum(1) - 2 * unit[a : a + 1024] @ self.centroids.T).argmin(1)
        return out

    def coded(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), len(self.codebooks)), np.uint8)
        for a in range(0, len(unit), 1024):
            rest = self.split(unit[a : a + 1024] - self.centroids[lists[a : a + 1024]])
            for j, book in enumerate(self.codebooks):
                out[a : a + 1024, j] = (np.square(book).sum(1) - 2 * rest[:, j] @ book.T).argmin(1)
        return out


def units(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten().cast(pa.float32())).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _fine(v: Column, dimension: int) -> Column:
    return F.coalesce((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def bounded_sample(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """At most n rows, those of smallest hash of their id: the same ones in any run. Only the rows of the bucket of hashes where the n-th
    one falls are sorted."""
    hashed = F.xxhash64(F.col(id_col))
    bucket = F.shiftright(hashed, 54)
    sizes, taken = dict(map(tuple, df.groupBy(bucket.alias("b")).agg(F.count("*")).collect())), 0  # 1024 buckets at most
    for b in sorted(sizes):
        if taken + sizes[b] > n:
            rest = df.where(bucket == b).orderBy(hashed, id_col).limit(n - taken)
            return df.where(bucket < b).unionByName(rest) if taken else rest
        taken += sizes[b]
    return df


def probes_for(model: Model, unit: np.ndarray, share: float, k: int = 10) -> int:
    """The fewest lists, nearest first, that hold this share of the k nearest rows of the first ASKING ones, on average."""
    q = unit[:ASKING]
    if len(unit) < 2:
        return 1
    near = q @ unit.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argpartition(-near, min(k, len(unit) - 1) - 1, axis=1)[:, :k]
    order = np.argsort(np.square(model.centroids).sum(1) - 2 * q @ model.centroids.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)[np.arange(len(q))[:, None], model.assigned(unit)[best]]
    return int(np.sort(place.reshape(-1))[math.ceil(share * place.size) - 1]) + 1


def _centres(batches: Iterator[pa.RecordBatch], k: int, seed: int, rounds: int = 20) -> Iterator[pa.RecordBatch]:
    """k centres of unit vectors by cosine, from one task's rows; a centre without rows stays where it is."""
    x = np.concatenate([units(b.column(0)) for b in batches if b.num_rows])
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)] if k > 1 else x.mean(0, keepdims=True)
    for _ in range(rounds if k > 1 else 0):
        sums, n = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for a in range(0, len(x), 1024):
            own = (x[a : a + 1024] @ centres.T).argmax(1)
            np.add.at(sums, own, x[a : a + 1024])
            n += np.bincount(own, minlength=len(centres))
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where((n[:, None] > 0) & (length > 0), sums / np.maximum(length, 1e-12), centres).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([centres.astype("<f4").tobytes()], pa.binary())], ["centres"])


def fit(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, parts: int | None = None, sample: int = SAMPLE, share: float = 0.97, seed: int = 42) -> Model:
    """The model of a table: lists defaults to the root of the number of rows, within 1 and MOST_LISTS; parts to a
    byte for two components, 16 at least; share: see probes_for()."""
    mode = stats.dimension_mode(df, vector_col, "larger").first()
    if mode is None:
        return Model(np.zeros((1, 1), np.float32), np.zeros((1, 1, 1), np.float32))
    dimension = int(mode["dimension"])
    parts = parts or max(16, -(-dimension // 2))
    rows = df.where(_fine(F.col(vector_col), dimension)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = rows.count()
    taken = written(bounded_sample(rows.where(vectors.norm(F.col("v")) > 1e-12), sample, "id"), "sample")  # a unit vector as a column would take its norm anew for each component
    held = min(n, sample)
    k = max(1, min(lists or math.isqrt(n), MOST_LISTS, held))
    if taken.isEmpty():
        return Model(np.zeros((1, dimension), np.float32), np.zeros((parts, 1, -(-dimension // parts)), np.float32))
    found = taken.select("v").coalesce(1).mapInArrow(partial(_centres, k=k, seed=seed), "centres binary").first()  # of the sample, whose size is bounded
    coarse = Model(np.frombuffer(found.centres, "<f4").reshape(-1, dimension), np.zeros((parts, 1, -(-dimension // parts)), np.float32))

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(b.column(0))
            rest = coarse.split(x - coarse.centroids[coarse.assigned(x)])
            for j in range(rest.shape[1]):
                flat = np.ascontiguousarray(rest[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, np.int32)), pa.array(list(flat), pa.list_(pa.float32()))], ["part", "v"])

    def book(table: pa.Table) -> pa.Table:
        x = np.asarray(table["v"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        return pa.table({"part": table["part"][:1], "book": pa.array([lloyd(x.astype(np.float32), 256, 12, seed).astype("<f4").tobytes()], pa.binary())})

    books = taken.select("v").mapInArrow(residuals, "part int, v array<float>").groupBy("part").applyInArrow(book, "part int, book binary").collect()  # one small book for each part
    width = coarse.codebooks.shape[2]
    some = np.array([r.v for r in bounded_sample(taken, TUNED, "id").select("v").collect()])  # TUNED rows at most
    some = (some / np.linalg.norm(some, axis=1, keepdims=True)).astype(np.float32)
    dropped(taken)
    return Model(coarse.centroids, np.stack([np.frombuffer(r.book, "<f4").reshape(-1, width) for r in sorted(books)]), probes_for(coarse, some, share))


@dataclass(frozen=True)
class Index:
    """A written index: `<path>/model`, `<path>/rows` and `<path>/codes`, the last two with a folder for each list."""

    spark: SparkSession
    path: str
    model: Model
    id_type: str

    def rows(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/rows", f"id {self.id_type}, v array<float>, at long, part int, list int")

    def codes(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/codes", "part int, ats binary, codes binary, list int")


def _stored(model: Model, id_type: str) -> tuple:
    return (id_type, *model.centroids.shape, *model.codebooks.shape, model.probes, model.centroids.astype("<f4").tobytes(), model.codebooks.astype("<f4").tobytes())


def create(spark: SparkSession, path: str, model: Model, id_type: str = "long") -> Index:
    """An empty index of a model at a new path."""
    spark.createDataFrame([_stored(model, id_type)], "id_type string, lists int, dimension int, parts int, codes int, width int, probes int, centroids binary, codebooks binary").coalesce(1).write.parquet(f"{path}/model")
    return Index(spark, path, model, id_type)


def load(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/model").first()
    return Index(spark, path, Model(np.frombuffer(r.centroids, "<f4").reshape(r.lists, r.dimension), np.frombuffer(r.codebooks, "<f4").reshape(r.parts, r.codes, r.width), r.probes), r.id_type)


def _assigned(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.assigned(units(b.column(1))))], ["id", "v", "list"])


def _blocks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Codes of consecutive rows of one list, BLOCK at most. Rows come in order of their lists."""
    for whole in batches:
        lists = np.asarray(whole.column("list"))
        cuts = sorted({0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), whole.num_rows})
        for first, last in ((a, min(a + BLOCK, end)) for start, end in zip(cuts, cuts[1:], strict=False) for a in range(start, end, BLOCK)):
            piece = whole.slice(first, last - first)
            codes = model.coded(units(piece.column("v")), lists[first:last])
            at = np.asarray(piece.column("at")).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(lists[first : first + 1]), piece.column("part").slice(0, 1), pa.array([at.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["list", "part", "ats", "codes"])


def add(index: Index, df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Every fit row of df, assigned to its list and coded; files are added, none rewritten."""
    dimension = index.model.centroids.shape[1]
    kind = index.id_type
    picked = df.where(_fine(F.col(vector_col), dimension)).select(F.col(id_col).cast(kind).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("float")).alias("v"))
    held = index.rows().agg(F.max("part")).first()[0]
    part = 0 if held is None else held + 1
    assigned = picked.mapInArrow(partial(_assigned, model=index.model), f"id {kind}, v array<float>, list int")
    keys = ["list", F.xxhash64("id"), "id"]
    placed = assigned.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.lit(part))
    placed.write.mode("append").partitionBy("list").parquet(f"{index.path}/rows")
    index.rows().where(F.col("part") == part).select("list", "part", "at", "v").sortWithinPartitions("list", "at").mapInArrow(partial(_blocks, model=index.model), "list int, part int, ats binary, codes binary").write.mode("append").partitionBy("list").parquet(f"{index.path}/codes")
    return index


def _order(model: Model, x: np.ndarray, probes: int) -> np.ndarray:
    """The nearest lists of each query, nearest first."""
    return np.argsort(np.square(model.centroids).sum(1) - 2 * x @ model.centroids.T, axis=1, kind="stable")[:, :probes]


def _probes(batches: Iterator[pa.RecordBatch], model: Model, probes: int) -> Iterator[pa.RecordBatch]:
    """(list): those that any query of the task probes."""
    wanted = np.zeros(len(model.centroids), bool)
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            wanted[_order(model, units(b.column(0).slice(a, 1024)), probes)] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(wanted).astype(np.int32))], ["list"])


class _Best:
    """The `few` best codes of each query of a block among the lists that it probes, of the blocks of codes met so far."""

    def __init__(self, q: pa.Array, x: np.ndarray, model: Model, probes: int, few: int) -> None:
        self.q, self.model, self.few = q, model, few
        self.x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.probed = np.zeros((len(x), len(model.centroids)), bool)
        self.probed[np.arange(len(x))[:, None], _order(model, self.x, probes)] = True
        self.least = np.full(len(x), -np.inf, np.float32)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def scan(self, own: int, part: int, ats: np.ndarray, codes: np.ndarray) -> None:
        who = np.flatnonzero(self.probed[:, own])
        if not len(who):
            return
        rest = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.model.codebooks)], axis=1)[:, : self.x.shape[1]]
        near = self.x[who] @ (self.model.centroids[own] + rest).T
        at = np.flatnonzero(near >= self.least[who][:, None])
        row, place = who[at // len(ats)], ats[at % len(ats)]
        self.held.append((row, np.full(len(row), own, np.int32), np.full(len(row), part, np.int32), place, near.reshape(-1)[at]))
        self.size += len(row)
        if self.size > max(1 << 19, 3 * self.few * len(self.x)):
            self.trim()

    def trim(self) -> tuple[np.ndarray, ...]:
        row, lists, part, at, near = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((at, part, lists, -near, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.few - 1
        self.least[row[last]] = near[order[last]]
        kept = order[place < self.few]
        self.held = [(row[place < self.few], *(c[kept] for c in (lists, part, at, near)))]
        self.size = len(kept)
        return self.held[0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            row, *others = self.trim()
            yield pa.RecordBatch.from_arrays([self.q.take(pa.array(row)), *map(pa.array, others)], ["q", "list", "part", "at", "near"])


def _scanned(batches: Iterator[pa.RecordBatch], model: Model, probes: int, few: int) -> Iterator[pa.RecordBatch]:
    """(q, list, part, at, near): the best `few` codes of a task for each query. Blocks of one block of queries come in a row."""
    block, best = None, None
    for b in batches:
        for i in range(b.num_rows):
            if best is None or b.column("_b")[i].as_py() != block:
                if best is not None:
                    yield from best.rows()
                block, q = b.column("_b")[i].as_py(), b.column("_q")[i].values
                best = _Best(q, matrix(b.column("_qx")[i], len(q), model.centroids.shape[1]), model, probes, few)
            ats = np.frombuffer(b.column("ats")[i].as_buffer(), "<i8")
            best.scan(b.column("list")[i].as_py(), b.column("part")[i].as_py(), ats, np.frombuffer(b.column("codes")[i].as_buffer(), np.uint8).reshape(len(ats), -1))
    if best is not None:
        yield from best.rows()


def search(index: Index, queries: DataFrame, k: int, *, probes: int | None = None, refine: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score): about the k nearest by cosine of each query row, from its `probes` nearest lists (the default: the
    model's). The `refine` best
    by code (the default: 8 k + 32) are scored by their exact vectors."""
    model, few = index.model, refine or 8 * k + 32
    usable = queries.where(_fine(F.col(vector_col), model.centroids.shape[1])).select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("query_id"), F.transform(F.col(vector_col), lambda x: x.cast("float")).alias("v"))
    asked = written(usable, "queries")
    probes = probes or model.probes
    wanted = [r["list"] for r in asked.select("v").mapInArrow(partial(_probes, model=model, probes=probes), "list int").distinct().collect()]  # MOST_LISTS at most
    dealt = asked.repartition(max(1, -(-asked.count() // PACK)), "q")
    packs = packed(dealt, model.centroids.shape[1], "packs", id_col="q", vector_col="v", rows=PACK)
    left = packs.select(F.monotonically_increasing_id().alias("_b"), F.col("ids").alias("_q"), F.col("x").alias("_qx"))
    codes = index.codes().where(F.col("list").isin(wanted)).select("list", "part", "ats", "codes")
    met = left.hint("shuffle_replicate_nl").crossJoin(codes.coalesce(index.spark.sparkContext.defaultParallelism))  # files of a list are small
    scanned = met.mapInArrow(partial(_scanned, model=model, probes=probes, few=few), "q long, list int, part int, at long, near float")
    best = Window.partitionBy("q").orderBy(F.desc("near"), "list", "part", "at")
    candidates = written(scanned.withColumn("r", F.row_number().over(best)).where(F.col("r") <= few).drop("r", "near"), "candidates")
    exact = index.rows().where(F.col("list").isin(wanted)).join(candidates, ["list", "part", "at"]).join(asked.select("q", "query_id", F.col("v").alias("qv")), "q").where(~F.col("id").eqNullSafe(F.col("query_id")))
    scored = exact.select("q", "query_id", "id", F.round(vectors.cosine(F.col("v"), F.col("qv")), digits).alias("score"))
    last = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def recall(found: DataFrame, exact: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """(queries, recall): the share of exact neighbours found. A found row whose score ties with the exact result's last one counts as
    well as the one whose place it has."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").where(F.col("score") >= F.col("last") - 1e-9).groupBy("query_id").agg(F.count("*").alias("hits"))
    each = last.join(hits, "query_id", "left").select(F.least(F.coalesce("hits", F.lit(0)), "n").alias("hits"), "n")
    return each.agg(F.count("*").alias("queries"), (F.sum("hits") / F.sum("n")).alias("recall"))
