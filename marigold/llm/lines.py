"""Line dedup by two Bloom filters.

Lines are cut at "\\n" (null or empty text: one empty line). A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z
lower-cased. A first scan puts the hashes of all keys into two Bloom filters, for once-seen and twice-seen; a second scan lets only
lines pass that the twice-seen filter suspects. These alone are shuffled, as 128-bit digests of their keys, for the exact count of
documents and the choice of the first occurrence. The dropped line numbers then go back to their documents by one join.

Defined results: rows are documents, repeated rows included, and equal rows get equal results; a null doc_id is a document like any
other, first in order; keys shorter than min_chars are never dropped. Rows, their order of columns and extra columns stay.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigold.llm import bloom
from marigold.llm.common import SPACES, slices, tidy
from marigold.lineage import written

RESULT = "line_dedup"


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """Each line's key, or None where it has fewer than min_chars code points."""
    keys = [line.strip(SPACES).lower() for line in text.split(b"\n")]
    if min_chars <= 0:
        return keys
    if min_chars == 1:
        return [k or None for k in keys]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else None for k in keys]


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[bytes]:
    for x in batch.column(i):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _document_hashes(text: bytes, min_chars: int) -> tuple[dict[bytes, list[int]], np.ndarray]:
    """Line numbers by key, and the keys' hashes in the same order."""
    places: dict[bytes, list[int]] = {}
    for i, key in enumerate(keys_of(text, min_chars)):
        if key is not None:
            places.setdefault(key, []).append(i)
    return places, np.fromiter(map(xxhash.xxh3_64_intdigest, places), np.uint64, len(places))


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int, within: bool) -> Iterator[np.ndarray]:
    """Hashes of the keys: once for each document, or, if repeats within a document count, for each line."""
    for batch in batches:
        for text in _texts(batch, 0):
            places, h = _document_hashes(text, min_chars)
            yield np.repeat(h, [min(2, len(x)) for x in places.values()]) if within and len(h) else h


@tidy
def _suspects(batches: Iterator[pa.RecordBatch], twice: Broadcast, min_chars: int) -> Iterator[pa.RecordBatch]:
    test = twice.value
    for batch in itertools.chain.from_iterable(map(slices, batches)):
        ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        keys, rows, lines = [], [], []
        held = [_document_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", min_chars) for x in texts]
        found = test(np.concatenate([h for _, h in held])) if held else np.zeros(0, bool)
        at = 0
        for i, (places, h) in enumerate(held):
            hit = found[at : at + len(h)]
            at += len(h)
            if hit.any():
                for key, yes in zip(places, hit.tolist(), strict=True):
                    if yes:
                        keys.append(hashlib.blake2b(key, digest_size=16).digest())
                        rows.append(i)
                        lines.append(places[key])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([ids[i] for i in rows], pa.int64()), pa.array([hashes[i] for i in rows], pa.int64()), pa.array(lines, pa.list_(pa.int32()))], ["key", "doc_id", "h", "lines"])


@tidy
def _kept(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its kept lines; the last column, dropped line numbers, becomes the result struct."""
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, gone in zip(_texts(batch, text_at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines, gone = text.split(b"\n"), set(gone or ())
            texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            counts.append(len(lines))
            dropped.append(len(gone))
        columns = batch.columns[:-1]
        columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
        result = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["n_lines", "n_dropped"])
        yield pa.RecordBatch.from_arrays([*columns, result], [*batch.schema.names[:-1], RESULT])


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines dropped from the text, and a column line_dedup (n_lines before dropping, n_dropped).

    A key found in at least min_docs documents loses all its lines with keep="none", and all but its first (smallest doc_id, then
    earliest line) with keep="first". With keep="first" and min_docs=1, lines repeated within one document go too."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    docs = docs.drop(RESULT)
    text, within = F.col(f"`{text_col}`").cast("string"), keep == "first" and min_docs <= 1
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    lines = slim.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    filtered = bloom.twice_seen(slim.select("text"), partial(_hashes, min_chars=min_chars, within=within), lines)
    twice = docs.sparkSession.sparkContext.broadcast(filtered if min_docs > 1 or within else bloom.TwiceSeen(np.full_like(filtered.bits, 255)))
    hashed = slim.select("doc_id", F.xxhash64("text").alias("h"), "text")
    suspects = written(hashed.mapInArrow(partial(_suspects, twice=twice, min_chars=min_chars), "key binary, doc_id long, h long, lines array<int>"), "suspects")
    place = F.struct("doc_id", "h", F.element_at("lines", 1).alias("line"))
    repeated = suspects.groupBy("key").agg(F.count("*").alias("n"), *([F.min(place).alias("first")] if keep == "first" else [])).where(F.col("n") >= min_docs)
    repeated = written(repeated, "repeated")  # a table, so that a join with a hot key can be split
    gone = suspects.join(repeated, "key")
    if keep == "first":
        first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
        gone = gone.withColumn("lines", F.when(first, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))).where(F.size("lines") > 0)
    gone = gone.groupBy(F.col("doc_id").alias("_mg_id"), F.col("h").alias("_mg_h")).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("_mg_lines"))
    # the text's hash tells apart documents that share an id
    keyed = docs.withColumn("_mg_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_mg_id")) & (F.col("_mg_key") == F.col("_mg_h")), "left")
    names = [f"c{i}" for i in range(len(docs.columns))]  # plain names: the Arrow step takes no dots
    joined = joined.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), "_mg_lines")
    fields = [T.StructField(n, T.StringType() if f.name == text_col else f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField(RESULT, T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))])
    out = joined.mapInArrow(partial(_kept, text_at=docs.columns.index(text_col)), schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)), RESULT)
