"""What the operators of this subpackage share: Arrow text buffers, word hashes and n-grams.

Hashes of words are sums of per-byte random 64-bit codes, each times a random multiplier of its place in the word, taken from prefix
sums in steps, so that no Python object is made per word. All arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
if (_set := getattr(ctypes.CDLL(None), "mallopt", None)) is not None:
    _set(-3, 2 << 20)  # arrays of 2 MB and more are mapped, so that they go back to the system when they are freed

#: [\x20\x09-\x0D], the white space of the line and word contracts.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that a vectorised step handles at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Values that are hashed at once.
STEP = 1 << 16
#: What a worker keeps between tasks of one module: how to let it go, by the module's name. Passes of other modules do so first.
KEPT: dict[str, Callable[[], None]] = {}


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and the n + 1 offsets of its rows in them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = pc.fill_null(wide, b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None and len(wide) else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(wide) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most `limit` text bytes; a longer row stands alone."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def release() -> None:
    """Gives memory that earlier chunks no longer need back to the system; allocators would keep it for the worker's lifetime."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A step over batches that gives memory back before it begins and when it ends: a worker keeps, also while it is idle, what its
    last task left, and a stage with two steps in a row has twice as many workers."""

    @functools.wraps(step)
    def run(*args, **kwargs):
        for module, forget in KEPT.items():
            if module != step.__module__:
                forget()
        release()
        try:
            yield from step(*args, **kwargs)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEYS = constants(1 << 12, 0x2545F491)


def _keys(at: np.ndarray) -> np.ndarray:
    """A random odd 64-bit multiplier for each place in a span."""
    if not len(at) or at.max() < len(_KEYS):
        return _KEYS[at]
    return mix((at + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F491)) | np.uint64(1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of `values`, lengths included: 64-bit codes, or with `codes` numbers of such. Every place of a span has
    a multiplier of its own. Steps of STEP values, so that what a step needs stays small however long the buffer and its spans are."""
    lengths = ends - starts
    edges = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, int(edges[-1]), STEP):
        b = min(a + STEP, int(edges[-1]))
        i, j = int(np.searchsorted(edges, a, "right")) - 1, int(np.searchsorted(edges, b, "left"))
        cuts = np.clip(edges[i : j + 1], a, b)
        at = np.arange(a, b) - np.repeat(edges[i:j], np.diff(cuts))
        part = values[at + np.repeat(starts[i:j], np.diff(cuts))]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((part if codes is None else codes[part]) * _keys(at), out=sums[1:])
        out[i:j] += np.diff(sums[cuts - a])
    return mix(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


_SPACE_SET = byte_set(SPACES)


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE_SET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each row, and the n + 1 offsets of the rows in the list of words. No word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edge = offsets[1:][offsets[1:] > 0]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z."""
    return span_hashes(data, starts, ends, _CODES[_LOWER] if lower else _CODES)


def gram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words of an array of word hashes; callers leave out those that cross rows."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i, k in enumerate(constants(n, seed)):
        total += words[i : i + count] * k
    return mix(total)


def within_rows(word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that lie in one row, in order, and how many each row has."""
    counts = np.maximum(np.diff(word_offsets) - n + 1, 0)
    total = int(counts.sum())
    firsts = np.repeat(word_offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return firsts + np.arange(total), counts
