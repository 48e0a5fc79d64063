"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

Index. Documents are dealt to shards of some megabytes of text. A shard is one row of a written table: its terms' hashes in order, the
bounds of each term's run of postings, and the postings, document numbers within the shard and what an occurrence adds to a score before
the term's weight: a compressed sparse row matrix. The lengths of all documents go into that impact, so the matrix is first written with
frequencies and then, with the corpus's totals, with impacts.

Search. Queries come in blocks of bounded size. A block's terms get their document frequencies from the shards' dictionaries (those
columns alone are read), hence their weights. Each shard then adds, query by query and term by term, weight times impact into a dense
array of its documents' scores, takes the k best by partition, ties at the k-th kept until the order of ids decides, and merges them
with those of the other shards that its task reads. A last ranking merges the tasks' best.

Defined results: terms are maximal runs of ASCII letters and digits and of all other code points above 0x7F, A-Z lower-cased; null
texts and texts without terms have no postings; a null document id comes first among equal scores; repeated documents are documents of
their own, and so are repeated queries; queries without terms, or without a document that scores above 0, have no rows. Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigold.lineage import dropped, scratch, written
from marigold.llm.common import buffers, byte_set, release, slices, word_hashes, word_spans

#: Every byte that ends a term.
SEPARATORS = byte_set(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Text of a shard, and queries and bytes of their text in a block.
SHARD_BYTES, BLOCK_ITEMS, BLOCK_BYTES = 8 << 20, 4096, 4 << 20
#: Saturation and length normalisation in hundredths, as the impact has them.
LENGTH_SHARE = 50
_SHARD = "shard long, n_docs long, ids array<long>, terms binary, bounds binary, docs binary"


def term_hashes(piece: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a batch, and how many each row has."""
    data, offsets = buffers(piece.column(column))
    starts, ends, rows = word_spans(data, offsets, SEPARATORS)
    return word_hashes(data, starts, ends, lower=True), np.diff(rows)


def _shard(number: int, ids: pa.Array, hashes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Postings with frequencies: documents are numbered by their place in ids."""
    terms, which = np.unique(hashes, return_inverse=True)
    keys, counts = np.unique(which.astype(np.int64) * max(len(lengths), 1) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(terms) + 1, dtype=np.int64) * max(len(lengths), 1))
    docs = (keys % max(len(lengths), 1)).astype(np.uint32)
    head = [pa.array([number], pa.int64()), pa.array([int((lengths > 0).sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    parts = [terms, bounds.astype(np.int64), docs, counts.astype(np.int64), lengths.astype(np.int64)]
    columns = [*head, *(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([int(lengths.sum())], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "n_docs", "ids", "terms", "bounds", "docs", "counts", "lengths", "n_terms"])


def _counted(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def whole() -> pa.RecordBatch:
        ids, hashes, lengths = zip(*held, strict=True)
        return _shard(part << 32 | made, pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(lengths))

    for batch in batches:
        for piece in slices(batch, "text"):
            size += len(buffers(piece.column("text"))[0])
            held.append((piece.column("id").cast(pa.int64()), *term_hashes(piece)))
            if size >= limit:
                yield whole()
                made, held, size = made + 1, [], 0
                release()
    if held:
        yield whole()
    release()


def _weighed(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """Frequencies become impacts: (10**9 * tf) div (1000 * tf + 20 * m), at most 10**6."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            docs, tf, lengths = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in (("docs", np.uint32), ("counts", np.int64), ("lengths", np.int64)))
            m = 100 - LENGTH_SHARE + np.array([LENGTH_SHARE * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
            impacts = ((10**9 * tf) // (1000 * tf + 20 * m[docs])).astype(np.uint32)
            kept = ["shard", "n_docs", "ids", "terms", "bounds", "docs"]
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.array([impacts.tobytes()], pa.binary())], [*kept, "impacts"])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a written table, one row for each shard."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = written(slim.mapInArrow(partial(_counted, limit=shard_bytes), _SHARD + ", counts binary, lengths binary, n_terms long"), "postings", heavy=True)
    n_docs, n_terms = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    index = written(counted.mapInArrow(partial(_weighed, n_docs=n_docs or 0, n_terms=n_terms or 1), _SHARD + ", impacts binary"), "impacts", heavy=True)
    dropped(counted)
    return index


Block = tuple[np.ndarray, list[np.ndarray]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in rows of bounded size: numbers, distinct terms end to end, and how many each query has. Queries without terms go."""
    part, seen, numbers, terms, size = TaskContext.get().partitionId(), 0, [], [], 0

    def row() -> pa.RecordBatch:
        parts = [np.array(numbers, np.int64), np.concatenate(terms), np.array([len(t) for t in terms], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["numbers", "terms", "sizes"])

    for batch in batches:
        for piece in slices(batch, "text"):
            hashes, lengths = term_hashes(piece)
            for i, own in enumerate(np.split(hashes, np.cumsum(lengths)[:-1])):
                if len(own):
                    own = np.unique(own)
                    if numbers and (len(numbers) == BLOCK_ITEMS or size + 8 * len(own) > BLOCK_BYTES):
                        yield row()
                        numbers, terms, size = [], [], 0
                    numbers.append(piece.column("number")[i].as_py())
                    terms.append(own)
                    size += 8 * len(own)
    if numbers:
        yield row()


def _runs(terms: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last posting of each wanted term in a shard; equal where it has none."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    held = terms[at] == wanted
    return np.where(held, bounds[at], 0), np.where(held, bounds[at + 1], 0)


def _frequencies(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, df): of the wanted terms, over all shards of the task."""
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            first, last = _runs(*(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("terms", np.uint64), ("bounds", np.int64))), wanted)
            total += last - first
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["term", "df"])


def best_of(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0, equal ones by id, ids that are not valid first."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        kth = scores[found[np.argpartition(scores[found], -k)[-k]]]
        found = found[scores[found] >= kth]
    return found[np.lexsort((ids[found], valid[found], -scores[found]))][:k]


def _searched(batches: Iterator[pa.RecordBatch], queries: Block, wanted: np.ndarray, weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(number, id, score): each query's best documents of all shards of the task."""
    numbers, terms = queries
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(numbers)
    for batch in batches:
        for i in range(batch.num_rows):
            read = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
            own = batch.column("ids")[i].values
            valid, ids = np.asarray(own.is_valid()), np.asarray(own.fill_null(0))
            first, last = (x.tolist() for x in _runs(read("terms", np.uint64), read("bounds", np.int64), wanted))
            docs, impacts = read("docs", np.uint32), read("impacts", np.uint32)
            scores = np.zeros(len(ids), np.int64)
            for q, mine in enumerate(terms):
                scores[:] = 0
                for t in mine:
                    if first[t] < last[t]:
                        scores[docs[first[t] : last[t]]] += weights[t] * impacts[first[t] : last[t]]
                found = best_of(scores, ids, valid, k)
                if len(found):
                    merged = [np.concatenate([a, b[found]]) for a, b in zip(best[q], (ids, valid, scores), strict=True)]
                    keep = best_of(merged[2], merged[0], merged[1], k)
                    best[q] = tuple(x[keep] for x in merged)
    for number, (ids, valid, scores) in zip(numbers, best, strict=True):
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids, pa.int64(), mask=~valid), pa.array(scores)], ["number", "doc", "score"])


def search(index: DataFrame, queries: DataFrame, *, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score): the k best documents of each query, from an index of build_index()."""
    spark = index.sparkSession
    numbered = written(queries.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).withColumn("number", F.monotonically_increasing_id()), "items")
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0
    path, found = scratch(spark, "found"), "number long, doc long, score long"
    spark.createDataFrame([], found).write.parquet(path)
    for row in numbered.select("number", "text").mapInArrow(_blocks, "numbers binary, terms binary, sizes binary").toLocalIterator():  # a block at a time
        numbers, terms, sizes = np.frombuffer(row.numbers, np.int64), np.frombuffer(row.terms, np.uint64), np.frombuffer(row.sizes, np.int64)
        wanted, places = np.unique(terms, return_inverse=True)
        df = index.select("terms", "bounds").mapInArrow(partial(_frequencies, wanted=wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the block's terms
        weights = np.zeros(len(wanted), np.int64)
        for r in df:
            weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        block = numbers, np.split(places, np.cumsum(sizes)[:-1])
        best = index.select("ids", "terms", "bounds", "docs", "impacts").mapInArrow(partial(_searched, queries=block, wanted=wanted, weights=weights, k=k), found)
        best.write.mode("append").parquet(path)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
    ranked = spark.read.schema(found).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("number", "item"), "number").select("item", "rank", "doc", "score")
