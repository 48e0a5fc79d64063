"""Documents packed into chunks of bounded size: one row holds an Arrow table of whole documents, compressed.

A chunk's number is that of its input partition and its place in it. Chunks are what operators shuffle and join when they need the
texts of many documents at hand and answers about them from elsewhere: an exchange of chunks is written once and read twice.

Input should be a table or any plan that gives a partition's rows in the same order when it runs again; answers carry a checksum of
what was asked, so that a plan that does not is an error and never a wrong result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from marigold.llm.common import buffers, slices, tidy

CHUNK_BYTES, LEVEL = 4 << 20, 6
#: Buckets to which chunks send what they ask, up to FAN_BYTES of text; beyond, as many more as the root of the size.
FAN, FAN_BYTES = 64, 64 << 30
SCHEMA = "chunk long, block binary"


def squeezed(content: bytes | pa.Buffer) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(content)


def spread(content: bytes | pa.Buffer) -> bytes:
    return zstandard.ZstdDecompressor().decompress(content)


@tidy
def packed(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows as chunks of about `limit` bytes of text; a longer document is a chunk of its own."""
    part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as writer:
            for piece in held:
                writer.write_batch(piece)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | count], pa.int64()), pa.array([squeezed(sink.getvalue())], pa.binary())], ["chunk", "block"])

    for batch in batches:
        for piece in slices(batch, column, limit // 4):
            nbytes = len(buffers(piece.column(column))[0])
            if held and size + nbytes > limit:
                yield chunk()
                count, held, size = count + 1, [], 0
            held.append(piece)
            size += nbytes
    if held:
        yield chunk()


def fan(size: int) -> int:
    """How many buckets a corpus of this size is dealt to: the same for most sizes, so that messages follow the number of chunks; above
    that, buckets and what each has to read grow alike."""
    return FAN * max(1, math.isqrt(-(-size // FAN_BYTES)))


def unpacked(block: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(spread(block)).read_all().combine_chunks()


def checksum(hashes: np.ndarray) -> int:
    """Of hashes in order, so that an answer can be held against what was asked."""
    return int(np.bitwise_xor.reduce(hashes * np.arange(1, 2 * len(hashes), 2, dtype=np.uint64))) >> 1 if len(hashes) else 0
