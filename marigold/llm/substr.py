"""Substring dedup by prefix-partitioned suffix trees.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is `window` consecutive words of one document. A word goes if a window that
covers it has a word sequence that also starts anywhere else, in the same document or another; windows are judged on the input.

1. Every window has an anchor, its GRAM-word sequence of least hash (the leftmost of equal ones). Equal windows have equal anchors,
   so only windows whose anchor's hash passes a twice-seen Bloom filter can repeat; all other suffixes are left out.
2. A suffix is the path of block hashes of its first `window` words, BLOCK words to a block (64 bits for the first block, 32 for
   each later one, 192 bits for 35 words). A sketch counts suffixes by prefix of one block, two blocks and so on. A suffix belongs to
   the shortest of its prefixes whose count fits a group; in the order of their hashes, prefixes of one length are put into groups
   until a group is full, so that prefixes of variable length make groups for memory.
3. Each group's task builds its subtrees as sorted paths with the lengths of common prefixes of neighbours: an internal node is a
   run of paths with a common prefix of its depth. Nodes as deep as the window are the repeats; the leaves under them are flagged,
   and one bit per suffix goes back to its chunk.
4. The chunk finds its windows again and removes the words that flagged ones cover. Flags that lie side by side make up the
   maximal repeats.

Equal suffixes of one chunk go to their group once, with a mark that there are several; a passage that a third of all documents
share therefore is one row per chunk. Defined results: null and empty texts have no words; rows stay one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigold.llm import bloom, chunks, sketch
from marigold.llm.common import buffers, constants, gram_hashes, mix, release, slices, tidy, within_rows, word_hashes, word_spans
from marigold.llm.pretokens import gather

BLOCK, GROUP, SKETCH = 7, 1 << 19, 1 << 16
RESULT = "substring_dedup"
_PLACE = 26  # bits of a position that break ties between equal hashes


def gram_size(window: int) -> int:
    return max(1, min(16, window // 2))


class Text:
    """Words of a slice of documents, and its windows with their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        self.starts, self.ends, self.rows = word_spans(data, offsets)
        self.words = word_hashes(data, self.starts, self.ends)
        self.firsts, self.counts = within_rows(self.rows, window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the anchor of each window, and the word at which it starts."""
        size = gram_size(self.window)
        grams, span = gram_hashes(self.words, size, 99), self.window - size + 1
        if not len(self.firsts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        low = np.uint64((1 << _PLACE) - 1)
        key = grams & ~low | np.arange(len(grams), dtype=np.uint64) & low
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        key = np.minimum(key[: len(grams) - span + 1], key[span - width : span - width + len(grams) - span + 1])
        key = key[self.firsts] & low
        place = self.firsts + ((key - self.firsts.astype(np.uint64)) & low).astype(np.int64)
        return grams[place], place

    def paths(self, at: np.ndarray) -> list[np.ndarray]:
        """Block hashes of the suffixes that start at these words, as far as the window goes."""
        out = []
        for j in range(0, self.window, BLOCK):
            size = min(BLOCK, self.window - j)
            total = np.zeros(len(at), np.uint64)
            for i, k in enumerate(constants(size, 1000 + size)):
                total += self.words[at + j + i] * k
            out.append(mix(total))
        return [out[0], *(x >> np.uint64(32) for x in out[1:])]


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Text]:
    for batch in batches:
        for piece in slices(batch):
            yield Text(*buffers(piece.column("text")), window)


def _anchor_hashes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[np.ndarray]:
    """One hash for each anchor, however many windows it serves."""
    for text in _pieces(batches, window):
        grams, place = text.anchors()
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        yield grams[new]


def _prefixes(paths: list[np.ndarray]) -> list[np.ndarray]:
    """A hash of each prefix of 1, 2, ... blocks, all blocks but the last."""
    out, h = [], np.zeros(len(paths[0]), np.uint64)
    for p in paths[: max(1, len(paths) - 1)]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(1))
        out.append(h)
    return out


def levels_of(window: int) -> int:
    return max(1, -(-window // BLOCK) - 1)


def _sketched(batches: Iterator[pa.RecordBatch], window: int, twice: Broadcast) -> np.ndarray:
    """How many suspected suffixes have a prefix of one block, two blocks and so on, by hash of the prefix."""
    counts = np.zeros((levels_of(window), SKETCH), np.int64)
    for text in _pieces(batches, window):
        grams, _ = text.anchors()
        for level, h in enumerate(_prefixes(text.paths(text.firsts[twice.value(grams)]))):
            counts[level] += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=SKETCH)
    return counts


def grouped(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """From counts by prefix length and hash: the group of each prefix that makes one (else -1), and how many groups there are.

    Groups hold up to GROUP suffixes, less on small inputs so that there are FAN of them; a longest prefix stands even if it exceeds that."""
    room = min(GROUP, max(1, int(-(-counts[0].sum() // chunks.FAN))))
    table, n = np.full(counts.shape, -1, np.int32), 0
    for level, c in enumerate(counts):
        chosen = (c > 0) & ((c <= room) | (level == len(counts) - 1))
        if chosen.any():
            table[level, chosen] = n + (np.cumsum(c[chosen]) - c[chosen]) // room
            n = int(table[level].max()) + 1
    return table, max(1, n)


class Suffixes:
    """The distinct suspected suffixes of a chunk, by the group of their prefix."""

    def __init__(self, table: pa.Table, window: int, twice: bloom.TwiceSeen, places: np.ndarray, groups: int):
        data, offsets = buffers(table["text"])
        self.text = Text(data, offsets, window)
        grams, _ = self.text.anchors()
        self.at = self.text.firsts[twice(grams)]
        paths = self.text.paths(self.at)
        whole = np.zeros(len(self.at), np.uint64)
        for p in paths:
            whole = mix(whole * np.uint64(0xD1342543DE82EF95) + p + np.uint64(7))
        self.hashes, first, self.numbers, self.times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        self.paths = [p[first] for p in paths]
        group = np.full(len(first), -1, np.int64)
        for level, h in enumerate(_prefixes(self.paths)):
            group = np.where(group < 0, places[level][(h >> np.uint64(48)).astype(np.int64)], group)
        if len(group) and group.min() < 0:
            raise RuntimeError("a suffix without a group: the input changed between two scans")
        self.order = np.argsort(group, kind="stable")
        self.edges = np.searchsorted(group[self.order], np.arange(groups + 1))


@tidy
def _sent(batches: Iterator[pa.RecordBatch], window: int, twice: Broadcast, places: Broadcast, groups: int) -> Iterator[pa.RecordBatch]:
    """A chunk's suffixes, one row per group: paths, and which occur several times in the chunk."""
    for batch in batches:
        for chunk, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Suffixes(chunks.unpacked(block.as_buffer()), window, twice.value, places.value, groups)
            rows = []
            for g in np.flatnonzero(np.diff(s.edges)):
                some = s.order[s.edges[g] : s.edges[g + 1]]
                content = s.paths[0][some].tobytes() + b"".join(p[some].astype(np.uint32).tobytes() for p in s.paths[1:])
                rows.append((int(g), chunk, chunks.checksum(s.hashes[some]), len(some), content, np.packbits(s.times[some] > 1).tobytes()))
            del s
            release()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["group", "chunk", "checksum", "n", "paths", "several"])


def repeated_leaves(paths: list[np.ndarray], several: np.ndarray) -> np.ndarray:
    """Of suffixes given by their paths: those under an internal node of full depth, or marked as several.

    The suffix tree is the sorted paths with the common prefix length of each neighbouring pair; an internal node at depth d is a
    run of neighbours that share at least d blocks."""
    order = np.lexsort(paths[::-1])
    alike = np.ones(max(0, len(order) - 1), bool)
    depth = np.zeros(len(alike), np.int64)
    for p in paths:
        q = p[order]
        alike &= q[1:] == q[:-1]
        depth += alike
    deep = depth == len(paths)
    flagged = several[order].copy()
    flagged[1:] |= deep
    flagged[:-1] |= deep
    out = np.empty(len(order), bool)
    out[order] = flagged
    return out


def _tree(table: pa.Table, blocks: int) -> pa.Table:
    sizes = np.asarray(table["n"]).astype(np.int64)
    columns: list[list[np.ndarray]] = [[] for _ in range(blocks)]
    several = []
    for n, content, marks in zip(sizes.tolist(), table["paths"], table["several"], strict=True):
        content = content.as_buffer()
        columns[0].append(np.frombuffer(content, np.uint64, n))
        for j in range(1, blocks):
            columns[j].append(np.frombuffer(content, np.uint32, n, 8 * n + 4 * n * (j - 1)))
        several.append(np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8), count=n).astype(bool))
    flags = repeated_leaves([np.concatenate(c) for c in columns], np.concatenate(several))
    bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([table["group"], table["chunk"], table["checksum"], table["n"], pa.array(bits, pa.binary())], names=["group", "chunk", "checksum", "n", "flags"])


def _removed(blocks: pa.Table, answers: pa.Table, window: int, twice: Broadcast, places: Broadcast, groups: int, separator: str) -> pa.Table:
    release()
    if not blocks.num_rows:
        raise RuntimeError("an answer without its chunk: the input changed between two scans")
    table = chunks.unpacked(blocks["block"][0].as_buffer())
    s = Suffixes(table, window, twice.value, places.value, groups)
    flags, missing = np.zeros(len(s.hashes), bool), set(np.flatnonzero(np.diff(s.edges)).tolist())
    for g, check, n, bits in zip(*(answers[c] for c in ("group", "checksum", "n", "flags")), strict=True):
        g, n = g.as_py(), n.as_py()
        some = s.order[s.edges[g] : s.edges[g + 1]]
        if g not in missing or n != len(some) or check.as_py() != chunks.checksum(s.hashes[some]):
            raise RuntimeError("the answer to a chunk does not fit its suffixes: the input changed between two scans")
        missing.discard(g)
        flags[some] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n).astype(bool)
    if missing:
        raise RuntimeError("a chunk has suffixes without an answer: the input changed between two scans")
    text, hit = s.text, s.at[flags[s.numbers]]
    change = np.zeros(len(text.starts) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    kept = np.cumsum(change[:-1]) == 0
    row_kept = np.diff(np.concatenate([[0], np.cumsum(kept)])[text.rows])
    n_words = np.diff(text.rows)
    starts, ends = text.starts[kept], text.ends[kept]
    row_edges = np.concatenate([[0], np.cumsum(row_kept)])
    if separator == "original":  # the white space that follows a word, up to the next word or the end of the text
        row_ends = np.concatenate([[0], np.cumsum(np.diff(buffers(table["text"])[1]))])[1:]
        following = np.append(text.starts[1:], 0)
        lasts = text.rows[1:][n_words > 0] - 1
        following[lasts] = row_ends[n_words > 0]
        lengths = following[kept] - starts
        joined = gather(text.data, starts, lengths)
        cut = np.zeros(len(n_words), np.int64)
    else:
        lengths = ends - starts + 1
        total = np.cumsum(lengths)
        joined = gather(np.append(text.data, np.uint8(32)), starts, lengths)
        joined[total - 1] = 32
        cut = (row_kept > 0).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])[row_edges]
    content = joined.tobytes()
    texts = [content[a : b - c].decode() for a, b, c in zip(edges[:-1].tolist(), edges[1:].tolist(), cut.tolist(), strict=True)]
    result = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_words - row_kept, pa.int64())], ["n_words", "n_removed"])
    columns = [pa.array(texts, pa.string()) if n == "text" else table[n] for n in table.column_names]
    return pa.Table.from_arrays([*columns, result], names=[*table.column_names, RESULT])


def dedup_substrings(docs: DataFrame, *, window: int = 35, separator: str = " ", text_col: str = "text") -> DataFrame:
    """docs with repeated words taken out of the text, and a column substring_dedup (n_words before, n_removed).

    Kept words are joined by one space, or with separator="original" each keeps the white space after it."""
    if separator not in (" ", "original") or window < 2:
        raise ValueError("separator is ' ' or 'original', and a window has at least two words")
    spark = docs.sparkSession
    docs = docs.drop(RESULT)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    slim = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = slim.select("text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    twice = spark.sparkContext.broadcast(bloom.twice_seen(texts, partial(_anchor_hashes, window=window), size / 6 * 2.2 / (window - gram_size(window) + 2)))
    blocks = -(-window // BLOCK)
    counts = sketch.summed(texts, partial(_sketched, window=window, twice=twice), levels_of(window) * SKETCH).reshape(-1, SKETCH)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places, groups = grouped(counts)
    places = spark.sparkContext.broadcast(places)  # a number for each cell of the sketch
    n = max(partitions, -(-size // chunks.CHUNK_BYTES))
    shared = {"window": window, "twice": twice, "places": places, "groups": groups}
    packed = slim.mapInArrow(chunks.packed, chunks.SCHEMA).repartition(n, "chunk")  # one exchange, used twice
    sent = packed.mapInArrow(partial(_sent, **shared), "group int, chunk long, checksum long, n int, paths binary, several binary")
    flags = sent.groupBy("group").applyInArrow(lambda table: _tree(table, blocks), "group int, chunk long, checksum long, n int, flags binary")
    schema = T.StructType([*slim.schema.fields, T.StructField(RESULT, T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))])
    out = packed.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(partial(_removed, **shared, separator=separator), schema)
    return out.select(*(F.col(names.get(c, "text")).alias(c) for c in docs.columns), RESULT)
