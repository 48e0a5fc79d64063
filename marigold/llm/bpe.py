"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are packed, compressed, into chunks of bounded size. Each chunk's texts become pre-tokens with positions, held as arrays:
the distinct words of the chunk in order of their hash, and a word number at each position. Only the distinct words are shuffled,
to the bucket of their hash; a bucket's task encodes each distinct word of the whole corpus once and answers every chunk that
asked (it forgets its words after KNOWN of them, which bounds its memory). The number of buckets is the same for most corpora, so that
messages follow the number of chunks. The ids join their chunk again and are put together by position. Decoding looks each id up in the token-byte table, whose
size is that of the vocabulary.

A chunk's own words come back in the order in which they were sent, under a checksum of their hashes; a mismatch is an error.
Words are told apart by a 64-bit hash within a chunk and by their bytes within a bucket.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are kept one by one, repeated or null ids included.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigold.llm import chunks, pretokens
from marigold.llm.chunks import spread, squeezed, unpacked
from marigold.llm.common import _CODES, buffers, release, span_hashes

#: Distinct words that a bucket's task remembers at a time.
KNOWN = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Words:
    """A chunk's pre-tokens: distinct words by hash, and which of them stands at each position."""

    def __init__(self, table: pa.Table):
        data, offsets = buffers(table["text"])
        starts, lengths, hashes, counts = [], [], [], []
        first = 0
        while first < len(offsets) - 1:  # the code points of a few megabytes at a time
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (2 << 20), "right")) - 1)
            a, b = int(offsets[first]), int(offsets[last])
            part, rows = data[a:b], offsets[first : last + 1] - a
            points, at, point_rows = pretokens.code_points(part, rows)
            s = pretokens.spaced_starts(points, point_rows)
            begin = at[s]
            stop = np.append(begin[1:], b - a)
            hashes.append(span_hashes(part, begin, stop, _CODES))
            starts.append(begin + a)
            lengths.append((stop - begin).astype(np.int32))
            counts.append(np.diff(np.searchsorted(s, point_rows)))
            first = last
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        starts, lengths, hashes = join(starts, np.int64), join(lengths, np.int32), join(hashes, np.uint64)
        self.row_counts = join(counts, np.int64)
        self.hashes, firsts, self.numbers = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.lengths, self.data = starts[firsts], lengths[firsts].astype(np.int64), data

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers ordered by bucket, first eight bytes and hash (neighbours that begin alike compress well), and where each
        bucket begins among them."""
        bucket = ((self.hashes >> np.uint64(8)) % np.uint64(n)).astype(np.int64)
        heads = np.zeros(len(bucket), np.uint64)
        for i in range(8):
            inside = self.lengths > i
            heads[inside] |= self.data[self.starts[inside] + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        order = np.lexsort((self.hashes, heads, bucket))
        return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct words, one row per bucket: lengths, and bytes end to end."""
    for batch in batches:
        for chunk, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = Words(unpacked(block.as_buffer()))
            order, edges = words.buckets(buckets)
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                some = order[edges[b] : edges[b + 1]]
                content = pretokens.gather(words.data, words.starts[some], words.lengths[some])
                rows.append((int(b), chunk, chunks.checksum(words.hashes[some]), squeezed(words.lengths[some].astype(np.int32).tobytes()), squeezed(content.tobytes())))
            del words
            release()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["bucket", "chunk", "checksum", "lengths", "words"])


def _answered(batches: Iterator[pa.RecordBatch], ranks: Broadcast) -> Iterator[pa.RecordBatch]:
    """The ids of the words asked for: how many each word has, and the ids end to end. Each distinct word is encoded once."""
    core = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks.value, special_tokens={})._core_bpe
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        for bucket, chunk, checksum, lengths, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, ids, at, words = [], [], 0, spread(words)
            for size in np.frombuffer(spread(lengths), np.int32).tolist():
                word = words[at : at + size]
                at += size
                got = known.get(word)
                if got is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    got = known[word] = core.encode_single_piece(word)
                counts.append(len(got))
                ids += got
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([checksum], pa.int64()), pa.array([squeezed(np.array(counts, np.uint32).tobytes())], pa.binary()), pa.array([squeezed(np.array(ids, np.uint32).tobytes())], pa.binary())], ["bucket", "chunk", "checksum", "counts", "ids"])


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _assembled(blocks: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The ids of each document of a chunk, by position."""
    release()
    if not blocks.num_rows:
        return _IDS.empty_table()
    table = unpacked(blocks["block"][0].as_buffer())
    words = Words(table)
    order, edges = words.buckets(buckets)
    counts, begins, ids, base = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes), np.int64), [], 0
    missing = set(np.flatnonzero(np.diff(edges)).tolist())
    for b, checksum, some_counts, some_ids in zip(*(answers[c] for c in ("bucket", "checksum", "counts", "ids")), strict=True):
        b, n = b.as_py(), np.frombuffer(spread(some_counts.as_buffer()), np.uint32).astype(np.int64)
        some = order[edges[b] : edges[b + 1]]
        if b not in missing or len(some) != len(n) or checksum.as_py() != chunks.checksum(words.hashes[some]):
            raise RuntimeError("the answer to a chunk does not fit its words: the input changed between two scans")
        missing.discard(b)
        counts[some], begins[some] = n, base + np.cumsum(n) - n
        ids.append(np.frombuffer(spread(some_ids.as_buffer()), np.uint32))
        base += len(ids[-1])
    if missing:
        raise RuntimeError("a chunk has words without an answer: the input changed between two scans")
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    row_edges = np.concatenate([[0], np.cumsum(words.row_counts)])
    token_edges = np.concatenate([[0], np.cumsum(counts[words.numbers])])[row_edges]
    out, first = [], 0
    rows = table.num_rows
    while first < rows:  # some megabytes of ids at a time
        last = max(first + 1, int(np.searchsorted(token_edges, token_edges[first] + (1 << 20), "right")) - 1)
        numbers = words.numbers[row_edges[first] : row_edges[last]]
        flat = pretokens.gather(ids, begins[numbers], counts[numbers])
        out.append(flat.astype("<u4"))
        first = last
    flat = np.concatenate(out) if out else np.zeros(0, "<u4")
    content = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer((token_edges * 4).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
    return pa.Table.from_arrays([table["doc_id"], pa.array(np.diff(token_edges), pa.int64()), content], schema=_IDS)


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text as little-endian unsigned 32-bit integers. vocabulary: path of a rank file."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    buckets = chunks.fan(size)
    packed = slim.mapInArrow(partial(chunks.packed, limit=chunk_bytes), chunks.SCHEMA).repartition(n, "chunk")  # one exchange, used twice
    asked = packed.mapInArrow(partial(_asked, buckets=buckets), "bucket int, chunk long, checksum long, lengths binary, words binary").repartition(buckets, "bucket")
    answers = asked.mapInArrow(partial(_answered, ranks=ranks), "bucket int, chunk long, checksum long, counts binary, ids binary")
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(partial(_assembled, buckets=buckets), "doc_id long, n_tokens long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], ranks: Broadcast, at: int) -> Iterator[pa.RecordBatch]:
    """Replaces column `at`, ids, by the bytes they stand for."""
    most = max(ranks.value.values())
    tokens: list[bytes] = [b""] * (most + 1)
    for token, rank in ranks.value.items():
        tokens[rank] = token
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    content, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths
    for whole in batches:
        release()
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            texts = []
            for x in batch.column(at):
                ids = np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4")
                if len(ids) and ids.max() > most:
                    raise ValueError("an id that the vocabulary lacks")
                texts.append(pretokens.gather(content, starts[ids], lengths[ids]).tobytes())
            columns, names = batch.columns, list(batch.schema.names)
            columns[at], names[at] = pa.array(texts, pa.binary()), "decoded"
            yield pa.RecordBatch.from_arrays(columns, names)


def decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with the bytes that its ids stand for, as `decoded`, in place of the ids. Null ids decode to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    fields = [T.StructField("decoded", T.BinaryType()) if f.name == ids_col else f for f in encoded.schema.fields]
    return encoded.mapInArrow(partial(_decoded, ranks=ranks, at=encoded.columns.index(ids_col)), T.StructType(fields))
