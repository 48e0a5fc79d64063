"""Keyword search through posting lists: an inverted index as written tables.

Documents are dealt to segments, within which they are numbered. A posting list holds the numbers of a segment's documents that have a
word: differences of ascending numbers in variable-length bytes, in blocks of BLOCK numbers, with a skip entry (last number, end in
bytes) for each block. Lists are range-partitioned and sorted by word, in small row groups, so that a search reads the row groups of its
words alone. Segments are made inside the tasks that read the documents; only finished lists are shuffled, one for each word and segment,
so that a word of all documents is spread over segments.

A search for all words meets the lists segment by segment: the shortest list is decoded, each longer one is entered through its skip
entries, and only blocks that can hold a number still sought are decoded. An index may keep the documents' hash embeddings, so that a
hybrid search ranks what it finds without reading texts. Adding documents writes new segments beside the old ones.

Words are those of functions.text.tokens; a null text has none. A null id and repeated ids are documents like others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.functions import hashing, text
from marigold.operators import search
from marigold.sources.readers import exists

#: Numbers in a block, documents and words of a segment at most (a longer document is a segment of its own), bytes of a row group.
BLOCK, SEGMENT_DOCS, SEGMENT_WORDS, ROW_GROUP = 128, 65_536, 4_000_000, 1 << 20


def encoded(numbers: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists end to end, each ascending, the i-th from cuts[i] to cuts[i + 1]: (bytes, bounds of the lists in them, last number of each
    block, its end in its list's bytes, bounds of the lists in blocks). The first number of a block is stored whole."""
    sizes = np.diff(cuts)
    place = np.arange(len(numbers)) - np.repeat(cuts[:-1], sizes)
    heads = np.flatnonzero(place % BLOCK == 0)
    gaps = np.diff(numbers, prepend=0)
    gaps[heads] = numbers[heads]
    gaps = gaps.astype(np.uint64)
    width = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        width += gaps >= np.uint64(1 << 7 * k)
    ends = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > k)
        more = np.where(width[some] > k + 1, 0x80, 0).astype(np.uint8)
        out[ends[some] + k] = (gaps[some] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | more
    last = np.append(heads[1:], len(numbers))[: len(heads)] - 1
    blocks = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
    of_list = np.repeat(np.arange(len(sizes)), np.diff(blocks))
    return out, ends[cuts], numbers[last], ends[last + 1] - ends[cuts[of_list]], blocks


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as binary values, after a null."""
    at = bounds.astype(np.int64) * values.itemsize
    held = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])
    return pa.concat_arrays([pa.array([None], pa.large_binary()), held]).cast(pa.binary())


def decoded(data: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The numbers of whole blocks of one list, or of lists of these sizes end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    gaps = np.add.reduceat((data & 0x7F).astype(np.int64) << 7 * at, starts)
    sums = np.cumsum(gaps)
    place = np.arange(len(gaps)) if sizes is None else np.arange(len(gaps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    heads = np.flatnonzero(place % BLOCK == 0)
    return sums - np.repeat(sums[heads] - gaps[heads], np.diff(np.append(heads, len(gaps))))


@dataclass(frozen=True)
class PostingList:
    data: np.ndarray
    lasts: np.ndarray
    ends: np.ndarray
    n: int

    def all(self) -> np.ndarray:
        return decoded(self.data)

    def among(self, sought: np.ndarray) -> tuple[np.ndarray, int]:
        """Which of the ascending numbers the list holds, and how many blocks were decoded for it."""
        block = np.searchsorted(self.lasts, sought)
        sought, block = sought[block < len(self.lasts)], block[block < len(self.lasts)]
        kept, read = [], np.unique(block)
        for b in read.tolist():
            numbers = decoded(self.data[self.ends[b - 1] if b else 0 : self.ends[b]])
            kept.append(np.intersect1d(sought[block == b], numbers, assume_unique=True))
        return (np.concatenate(kept) if kept else np.zeros(0, np.int64)), len(read)


def common(lists: Sequence[PostingList]) -> np.ndarray:
    """The numbers that all lists hold, the shortest list first."""
    ordered = sorted(lists, key=lambda x: x.n)
    held = ordered[0].all()
    for other in ordered[1:]:
        if not len(held):
            break
        held, _ = other.among(held)
    return held


def _segments(batches: Iterator[pa.RecordBatch], batch_no: int, docs: int, words: int) -> Iterator[pa.RecordBatch]:
    """(segment, word, n, lasts, ends, postings, ids, vectors): the lists of each segment; a row without word holds its documents' ids."""
    part, made, held, n_words = TaskContext.get().partitionId(), 0, [], 0

    def rows() -> pa.RecordBatch:
        lists = pa.concat_arrays([b.column(1) for b in held])
        ids = pa.concat_arrays([b.column(0) for b in held])
        number = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        segment = batch_no << 48 | part << 24 | made
        data, bounds, lasts, ends, blocks = encoded(number[order], cuts)
        n, own = len(cuts), pa.concat_arrays([b.column(2) for b in held])
        kept = np.asarray(own.flatten()).astype("<f8").tobytes() if own.null_count == 0 else None
        columns = [
            pa.array(np.full(n, segment, np.int64)), pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.cast(pa.string())]), pa.array([len(ids), *np.diff(cuts).tolist()], pa.int64()),
            _binaries(lasts.astype("<i8"), blocks), _binaries(ends.astype("<i8"), blocks), _binaries(data, bounds),
            pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * n], pa.int32()), ids), pa.array([kept, *[None] * (n - 1)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["segment", "word", "n", "lasts", "ends", "postings", "ids", "vectors"])

    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            piece = whole.slice(first, 512)
            size = int(pc.sum(pc.fill_null(piece.column(1).value_lengths(), 0)).as_py() or 0)
            if held and (n_words + size > words or sum(b.num_rows for b in held) + piece.num_rows > docs):
                yield rows()
                made, held, n_words = made + 1, [], 0
            held.append(piece)
            n_words += size
    if held:
        yield rows()


@dataclass(frozen=True)
class PostingIndex:
    """`<path>/lists`: (segment, word, n, lasts, ends, postings). `<path>/documents`: (segment, ids, vectors)."""

    spark: SparkSession
    path: str

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")


def add(index: PostingIndex, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = SEGMENT_DOCS, dimensions: int = 0) -> PostingIndex:
    """New segments for the documents of df; those already written stay as they are. dimensions: of the hash embeddings to keep."""
    spark, kind = index.spark, dict(df.dtypes)[id_col]
    held = index.documents().agg(F.max("segment")).first()[0] if exists(spark, f"{index.path}/documents") else None
    number = 0 if held is None else (held >> 48) + 1
    tokens = text.tokens(F.col(text_col))
    embedded = hashing.hashed_vectors(tokens, "sha256", dimensions) if dimensions else F.lit(None).cast("array<double>")
    words = df.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("words"), embedded.alias("vector"))
    made = words.mapInArrow(partial(_segments, batch_no=number, docs=segment_docs, words=SEGMENT_WORDS), f"segment long, word string, n long, lasts binary, ends binary, postings binary, ids array<{kind}>, vectors binary")
    staged = f"{index.path}/staged-{number}"
    made.write.parquet(staged)  # a list is made once, whatever is lost later
    rows = spark.read.parquet(staged)
    ordered = rows.where("word IS NOT NULL").drop("ids", "vectors").repartitionByRange("word", "segment").sortWithinPartitions("word", "segment")
    ordered.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(f"{index.path}/lists")
    rows.where("word IS NULL").select("segment", "ids", "vectors").write.mode("append").parquet(f"{index.path}/documents")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return index


def _met(table: pa.Table) -> pa.Table:
    """(segment, found): numbers of the segment's documents that all its lists hold."""
    read = lambda c, i, t: np.frombuffer(table[c][i].as_buffer(), t)
    lists = [PostingList(read("postings", i, np.uint8), read("lasts", i, "<i8"), read("ends", i, "<i8"), table["n"][i].as_py()) for i in range(table.num_rows)]
    found = common(lists)
    return pa.table({"segment": table["segment"][:1], "found": pa.array([found.astype(np.int32)], pa.list_(pa.int32()))})


def found_in_segments(index: PostingIndex, words: Sequence[str]) -> DataFrame:
    """(segment, found): numbers of the documents that hold every word; no words, no documents."""
    asked = sorted({w.lower() for w in words})
    if not asked:
        return index.spark.createDataFrame([], "segment long, found array<int>")
    own = F.lit(False)
    for w in asked:
        own = own | (F.col("word") == w)  # reaches the row groups however many words there are
    lists = index.lists().where(own)
    full = lists.groupBy("segment").agg(F.count("*").alias("words")).where(F.col("words") == len(asked)).select("segment")
    return lists.join(full, "segment", "left_semi").groupBy("segment").applyInArrow(_met, "segment long, found array<int>").where(F.size("found") > 0)


def holding_all(index: PostingIndex, words: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id): documents that hold every word."""
    met = found_in_segments(index, words).join(index.documents().select("segment", "ids"), "segment")
    return met.select(F.explode(F.transform("found", lambda i: F.get("ids", i))).alias(id_col))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.asarray(b.column("n"))
        numbers = decoded(np.frombuffer(b"".join(b.column("postings").to_pylist()), np.uint8), sizes)
        at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([b.column("segment").take(at), b.column("word").take(at), pa.array(numbers.astype(np.int32))], ["segment", "word", "number"])


def decoded_lists(index: PostingIndex) -> DataFrame:
    """(word, doc): every posting of the index."""
    numbered = index.lists().select("segment", "word", "n", "postings").mapInArrow(_decoded, "segment long, word string, number int")
    ids = index.documents().select("segment", F.posexplode("ids").alias("number", "doc"))
    return numbered.join(ids, ["segment", "number"]).select("word", "doc")


def _scored(batches: Iterator[pa.RecordBatch], query: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            found, own = b.column("found")[i].values, np.frombuffer(b.column("vectors")[i].as_buffer(), "<f8").reshape(-1, len(query))
            at = np.asarray(found)
            yield pa.RecordBatch.from_arrays([b.column("ids")[i].values.take(found), pa.array(own[at] @ query)], ["id", "score"])


def hybrid(index: PostingIndex, words: Sequence[str], query: str, k: int, *, dimensions: int = 64, id_col: str = "doc_id") -> DataFrame:
    """(id, score): documents with all words, ranked by cosine of the hash embeddings that the index keeps to the query's."""
    kind = dict(index.documents().dtypes)["ids"].removeprefix("array<").removesuffix(">")
    met = found_in_segments(index, words).join(index.documents(), "segment")
    q = np.array(search.embed_text(query, dimensions=dimensions))
    scored = met.select("found", "ids", "vectors").mapInArrow(partial(_scored, query=q), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), F.round("score", 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
