"""Count tables of fixed size, summed over input partitions in parts and sent to the driver once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marigold.llm.chunks import spread, squeezed
from marigold.llm.common import tidy

SCHEMA = "part int, counts binary"


@tidy
def _counted(batches: Iterator[pa.RecordBatch], counts: Callable[[Iterator[pa.RecordBatch]], np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each part of the partition's table that is not all zeros."""
    rows = [(i, squeezed(c.tobytes())) for i, c in enumerate(np.split(counts(batches).reshape(-1).astype(np.uint32, copy=False), parts)) if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "counts"])


@tidy
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            totals[part] = totals.get(part, 0) + np.frombuffer(spread(counts.as_buffer()), np.uint32).astype(np.int64)
    for part, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeezed(total.tobytes())], pa.binary())], ["part", "counts"])


def summed(df: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, parts: int = 64) -> np.ndarray:
    """The sum over partitions of `counts`, a function of a partition's batches that gives `size` counts below 2**32."""
    rows = df.mapInArrow(partial(_counted, counts=counts, parts=parts), SCHEMA).repartition(parts, "part").mapInArrow(_summed, SCHEMA)
    total = np.zeros((parts, size // parts), np.int64)
    for r in rows.toLocalIterator():  # at most `parts` rows
        total[r["part"]] = np.frombuffer(spread(r["counts"]), np.int64)
    return total.reshape(-1)
