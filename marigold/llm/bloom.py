"""Two Bloom filters over a corpus: hashes seen at least once, and hashes seen (as far as the first filter can tell) at least twice.

The hash space is cut into segments of 2**20 bits, so that a hash's probes lie in one segment and each segment is built by one
task, as a stream and in bounded memory, from the distinct hashes of each input partition. Only the twice-seen filter leaves the
executors. It has no false negatives: a hash met twice always passes. Its size is bounded by MAX_SEGMENTS (128 MB in all); beyond
about 6e7 hashes the share of singles that pass rises, which costs shuffled rows in what follows but never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigold.llm.common import mix, tidy

SEGMENT_BITS, MAX_SEGMENTS, PROBES, BITS_PER_HASH = 1 << 20, 1024, 4, 16
#: Distinct hashes that a map task holds before it passes them on.
FLUSH = 1 << 20

_MASK = np.uint64(SEGMENT_BITS - 1)
_SCHEMA = "segment int, once binary, again binary"


def segments_for(hashes: float) -> int:
    return int(min(MAX_SEGMENTS, max(1, -(-hashes * BITS_PER_HASH // SEGMENT_BITS))))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(42)) % np.uint64(segments)).astype(np.int64)


def _probes(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte numbers and bit masks of each probe within a segment."""
    at, step = h & _MASK, (h >> np.uint64(21)) & _MASK | np.uint64(1)
    for _ in range(PROBES):
        yield (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        at = (at + step) & _MASK


def _test(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    held = np.ones(len(h), bool)
    for byte, mask in _probes(h):
        held &= (bits[byte] & mask) != 0
    return held


def _add(bits: np.ndarray, h: np.ndarray) -> None:
    for byte, mask in _probes(h):
        np.bitwise_or.at(bits, byte, mask)


class TwiceSeen:
    """The filter as executors use it: (segments, bytes) of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        base = segment_of(h, len(self.bits)) * self.bits.shape[1]
        flat, held = self.bits.reshape(-1), np.ones(len(h), bool)
        for byte, mask in _probes(h):
            held &= (flat[base + byte] & mask) != 0
        return held


def _passed_on(parts: list[np.ndarray], segments: int) -> Iterator[pa.RecordBatch]:
    h, counts = np.unique(np.concatenate(parts), return_counts=True)
    s = segment_of(h, segments)
    order = np.argsort(s, kind="stable")
    h, counts, s = h[order], counts[order], s[order]
    numbers, firsts = np.unique(s, return_index=True)
    rows = [(int(n), x[c == 1].tobytes(), x[c > 1].tobytes()) for n, x, c in zip(numbers, np.split(h, firsts[1:]), np.split(counts, firsts[1:]), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "again"])


@tidy
def _hashed(batches: Iterator[pa.RecordBatch], hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], segments: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in hashes(batches):
        held.append(part)
        n += len(part)
        if n >= FLUSH:
            yield from _passed_on(held, segments)
            held, n = [], 0
    if n:
        yield from _passed_on(held, segments)


@tidy
def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            first, second = filters.setdefault(segment, (np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)))
            single, several = (np.frombuffer(x.as_buffer(), np.uint64) for x in (once, again))
            _add(second, single[_test(first, single)])
            _add(second, several)
            _add(first, single)
            _add(first, several)
    for segment, (_, second) in filters.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([second.tobytes()], pa.binary())], ["segment", "bits"])


def twice_seen(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: float) -> TwiceSeen:
    """The filter over what `hashes` yields for the batches of df; `expected`: about how many hashes, which sets its size."""
    segments = segments_for(expected)
    parts = df.mapInArrow(partial(_hashed, hashes=hashes, segments=segments), _SCHEMA).repartition(segments, "segment").mapInArrow(_built, "segment int, bits binary")
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in parts.toLocalIterator():  # at most MAX_SEGMENTS rows of 128 KB
        bits[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return TwiceSeen(bits)


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of a column, each twice, so that the twice-seen filter holds them all."""
    for batch in batches:
        yield np.repeat(mix(np.asarray(batch.column(0)).view(np.uint64)), 2)


def holding(keys: DataFrame, n: int) -> TwiceSeen:
    """A filter that passes all of n 64-bit keys, a column, and few others; ask it for mix(key)."""
    return twice_seen(keys, _mixed, n)


def without(docs: DataFrame, gone: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """docs but the rows whose id and text hash are in `gone` (_mg_id, _mg_h), a written table of distinct rows.

    A filter over the hashes goes to all tasks; rows that it does not hold stay where they are, and only the others are shuffled."""
    n = gone.count()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not n:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(holding(gone.select("_mg_h"), n))

    @F.arrow_udf("boolean")
    def suspected(h: pa.Array) -> pa.Array:
        return pa.array(held.value(mix(h.to_numpy(zero_copy_only=False).view(np.uint64))))

    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    keyed = docs.withColumn("_mg_key", key).withColumn("_mg_may", suspected("_mg_key"))
    match = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_mg_id")) & (F.col("_mg_key") == F.col("_mg_h"))
    left = keyed.where("_mg_may").join(gone, match, "left_anti")
    return keyed.where("NOT _mg_may").select(*columns).unionAll(left.select(*columns))
