"""Sequence packing by non-negative least squares.

Documents become token ids once, in a written table. A document's ids fill whole windows as far as they go; what is left over,
shorter than a window, is a remainder. The histogram of remainders, in bins of WINDOW / BINS tokens, is the right-hand side of a
non-negative least-squares problem whose columns are all combinations of at most DEPTH bins that fill a window. Its solution,
rounded down and capped by what each bin holds, says how often each combination is used. Remainders are numbered within their bin
by a distributed prefix count and so find their window; those beyond are residual and are laid end to end into windows, cut
where a window is full.

Words are looked up in a per-worker cache of bounded size, by a 64-bit hash, and the tokenizer encodes only words not met before.

Defined results: null and empty texts are the end id alone; every row is a document, repeated and null ids included.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigold.llm import pretokens
from marigold.llm.common import KEPT, mix, slices, span_hashes, tidy
from marigold.lineage import written

WINDOW, BINS, DEPTH, END_ID = 2048, 128, 3, 1
#: Words that a worker keeps, and residual tokens that one task lays out.
CACHE_WORDS, RESIDUAL_TOKENS = 1 << 20, 1 << 24


_POINT_CODES = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77))


def _point_codes(points: np.ndarray) -> np.ndarray:
    """A random 64-bit code for each code point."""
    if not len(points) or points.max() < 1 << 16:
        return _POINT_CODES[points]
    return np.where(points < 1 << 16, _POINT_CODES[points & 0xFFFF], mix(points.astype(np.uint64) + np.uint64(77)))


class WordCache:
    """Ids of words by hash, as sorted arrays."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.counts, self.begins = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids end to end. Words are encoded in lines of a thousand; each word's last id says so."""
        lines = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.array(list(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))), np.int64)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or (len(stops) and stops[-1] != len(ids)):  # a vocabulary without word ends
            each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            return np.fromiter(map(len, each), np.int64, len(each)), np.array(list(itertools.chain.from_iterable(each)), np.uint32)
        return np.diff(stops, prepend=0), ids.astype(np.uint32)

    def find(self, hashes: np.ndarray, word: callable) -> tuple[np.ndarray, np.ndarray]:
        """Counts and begins (in self.ids) of sorted distinct hashes; word(i) is the text of the i-th."""
        if len(self.hashes) > CACHE_WORDS:
            self._clear()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            counts, ids = self._encode([word(i) for i in new.tolist()])
            begins = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids])
            all_hashes = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(all_hashes, kind="stable")
            self.hashes = all_hashes[order]
            self.counts, self.begins = np.concatenate([self.counts, counts])[order], np.concatenate([self.begins, begins])[order]
        at = np.searchsorted(self.hashes, hashes)
        return self.counts[at], self.begins[at]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them without special tokens."""
        whole = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        plain = ["" if i in whole else t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for i, t in enumerate(texts)]
        joined, rows = "".join(plain), np.cumsum([0, *map(len, plain)])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = pretokens.bare_spans(points, rows)
        hashes, firsts, numbers = np.unique(span_hashes(_point_codes(points), starts, ends), return_index=True, return_inverse=True)
        counts, begins = self.find(hashes, lambda i: joined[starts[firsts[i]] : ends[firsts[i]]])
        flat = pretokens.gather(self.ids, begins[numbers], counts[numbers])
        edges = np.concatenate([[0], np.cumsum(counts[numbers])])[np.searchsorted(starts, rows)]
        return [whole.get(i, flat[edges[i] : edges[i + 1]]) for i in range(len(texts))]


@functools.lru_cache(maxsize=1)
def _cache(tokenizer_json: str) -> WordCache:
    return WordCache(tokenizer_json)


KEPT[__name__] = _cache.cache_clear


@tidy
def _tokenized(batches: Iterator[pa.RecordBatch], tokenizer: Broadcast) -> Iterator[pa.RecordBatch]:
    cache, part, at = _cache(tokenizer.value), TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in slices(batch, "text", 2 << 20):
            ids = [np.append(x, np.uint32(END_ID)).astype("<u4") for x in cache.encode(piece.column("text").to_pylist())]
            n = len(ids)
            wide = [x.astype("<u2") if not len(x) or x.max() < 1 << 16 else x for x in ids]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in wide], pa.binary())],
                ["doc_id", "part", "row", "doc_tokens", "ids"],
            )
            at += n


def tokenized(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, row, doc_tokens, ids): the ids of every whole text and the end id, two bytes each where all fit, else four."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(partial(_tokenized, tokenizer=shared), "doc_id long, part int, row long, doc_tokens long, ids binary")


def combinations(bins: int, depth: int) -> np.ndarray:
    """(bins, n): how often each combination of at most `depth` bin sizes that add up to `bins` uses each size 1 to bins."""
    found = []

    def extend(chosen: tuple[int, ...], left: int, least: int) -> None:
        if left >= least and len(chosen) < depth:
            found.append((*chosen, left))
        if len(chosen) + 1 < depth:
            for size in range(least, left // 2 + 1):
                extend((*chosen, size), left - size, size)

    extend((), bins, 1)
    a = np.zeros((bins, len(found)))
    for j, sizes in enumerate(found):
        for s in sizes:
            a[s - 1, j] += 1
    return a


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    gram, right = a.T @ a + 1e-9 * np.eye(n), a.T @ b  # the ridge keeps dependent columns solvable
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = np.abs(b).max() or 1.0
    for _ in range(3 * n):
        gain = right - gram @ x
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance * scale:
            break
        passive[j] = True
        while True:
            columns = np.flatnonzero(passive)
            s = np.linalg.solve(gram[np.ix_(columns, columns)], right[columns])
            if s.min(initial=1.0) > tolerance:
                x[:] = 0
                x[columns] = s
                break
            low = s <= tolerance
            step = x[columns][low] / np.maximum(x[columns][low] - s[low], 1e-300)
            x[columns] += min(1.0, step.min()) * (s - x[columns])
            passive &= x > tolerance
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The combinations used, (bins, n), and how often each: rounded down, then capped by the pieces that each bin still holds."""
    a = combinations(len(histogram), DEPTH)
    x = nonnegative_least_squares(a, histogram.astype(float))
    left, counts = histogram.astype(np.int64).copy(), np.zeros(a.shape[1], np.int64)
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        most = int((left[need > 0] // need[need > 0]).min())
        counts[j] = min(most, math.floor(x[j] + 1e-6))
        left -= need * counts[j]
    used = np.flatnonzero(counts)
    return a[:, used].astype(np.int64), counts[used]


class Slots:
    """Where the i-th piece of a bin goes: lists of (from number, columns), one entry per combination that uses the bin."""

    def __init__(self, combos: np.ndarray, counts: np.ndarray):
        bases = np.cumsum(counts) - counts
        self.total = int(counts.sum())
        self.lists = []
        for b in range(combos.shape[0]):
            entries, at = [], 0
            for j in np.flatnonzero(combos[b]):
                m = int(combos[b, j])
                entries.append((at, int(bases[j]), m, int(combos[:b, j].sum())))
                at += m * int(counts[j])
            self.lists.append((np.array([*(e[0] for e in entries), at], np.int64), np.array(entries, np.int64).reshape(-1, 4)))

    def place(self, bins: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the pieces with these numbers in these bins (from 1); -1 for residual pieces."""
        sequence, slot = np.full(len(bins), -1, np.int64), np.zeros(len(bins), np.int64)
        for b in np.unique(bins):
            starts, entries = self.lists[b - 1]
            here = np.flatnonzero((bins == b) & (numbers < starts[-1]))
            if len(here):
                e = entries[np.searchsorted(starts, numbers[here], "right") - 1]
                k = numbers[here] - e[:, 0]
                sequence[here] = e[:, 1] + k // e[:, 2]
                slot[here] = e[:, 3] + k % e[:, 2]
        return sequence, slot


def _placed(batches: Iterator[pa.RecordBatch], slots: Slots) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequence, slot = slots.place(np.asarray(batch.column("bin")), np.asarray(batch.column("number")))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "row", "start", "length")] + [pa.array(sequence), pa.array(slot)], ["part", "row", "start", "length", "sequence_id", "slot"])


def _laid_out(key: tuple, pieces: pa.Table) -> pa.Table:
    """Residual pieces end to end, longest first, cut where a window is full. Sequences are numbered within the group."""
    t = pieces.sort_by([("length", "descending"), ("part", "ascending"), ("row", "ascending")])
    length, start = np.asarray(t["length"]), np.asarray(t["start"])
    ends = np.cumsum(length)
    cuts = np.unique(np.concatenate([[0], ends, np.arange(WINDOW, ends[-1] if len(ends) else 0, WINDOW)]))
    piece = np.searchsorted(ends, cuts[:-1], "right")
    columns = [np.asarray(t["part"])[piece], np.asarray(t["row"])[piece], start[piece] + cuts[:-1] - (ends - length)[piece], np.diff(cuts), cuts[:-1] // WINDOW, cuts[:-1] % WINDOW]
    kinds = [pa.int32()] + [pa.int64()] * 5
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(piece), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["group", "part", "row", "start", "length", "sequence", "slot"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7
    for batch in batches:
        rows = []
        for doc_id, n, content, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "places")), strict=True):
            ids = np.frombuffer(content, "<u2" if len(content) == 2 * n else "<u4").astype("<u4")
            rows += [(doc_id, p["start"], p["length"], zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()), n, p["sequence_id"], p["offset"]) for p in sorted(places, key=lambda p: p["start"])]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). Each sequence holds at most WINDOW ids."""
    width = WINDOW // BINS
    tokens = written(tokenized(docs, tokenizer, id_col=id_col, text_col=text_col), name="tokens")
    sizes = tokens.select("part", "row", F.expr(f"doc_tokens div {WINDOW}").alias("windows"), (F.col("doc_tokens") % WINDOW).alias("rest")).withColumn("bin", F.ceil(F.col("rest") / width).cast("int"))
    # a prefix count over input partitions numbers the remainders of each bin, and the whole windows of documents by bin
    counts = sizes.groupBy("part", "bin").agg(F.count("*").alias("n"), F.sum("windows").alias("w"))
    counts = written(counts, "bins")
    histogram, windows = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():  # at most BINS + 1 rows
        histogram[r["bin"]], windows[r["bin"]] = r["n"], r["w"]
    histogram = histogram[1:]
    slots = Slots(*plan(histogram)) if histogram.any() else Slots(np.zeros((BINS, 0), np.int64), np.zeros(0, np.int64))
    before = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "bin", *(F.coalesce(F.sum(c).over(before("bin")), F.lit(0)).alias(f) for c, f in (("n", "first"), ("w", "first_window"))))
    within = Window.partitionBy("part", "bin").orderBy("row")
    rests = sizes.where("rest > 0").withColumn("local", F.row_number().over(within) - 1).join(firsts.drop("first_window"), ["part", "bin"])
    rests = rests.select("part", "row", (F.col("windows") * WINDOW).alias("start"), F.col("rest").alias("length"), "bin", (F.col("first") + F.col("local")).alias("number"))
    placed = written(rests.mapInArrow(partial(_placed, slots=slots), "part int, row long, start long, length long, sequence_id long, slot long"), name="placed")
    residual = placed.where("sequence_id < 0")
    tokens_left = residual.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, -(-tokens_left // RESIDUAL_TOKENS))
    laid = residual.withColumn("group", F.pmod(F.xxhash64("part", "row"), F.lit(groups))).groupBy("group").applyInArrow(_laid_out, "group long, part int, row long, start long, length long, sequence long, slot long")
    # groups hold about RESIDUAL_TOKENS / WINDOW sequences; numbers leave room for twice as many
    room = 2 * (RESIDUAL_TOKENS // WINDOW) + 2
    parts = ["part", "row", "start", "length", "sequence_id", "slot"]
    number = F.when(F.col("sequence") < room, F.col("sequence")).otherwise(F.raise_error(F.lit("a residual group is more than twice as large as planned")).cast("long"))
    laid = laid.withColumn("sequence_id", F.lit(slots.total) + F.col("group") * room + number).select(*parts)
    base = slots.total + groups * room
    running = Window.partitionBy("part", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.where("windows > 0").withColumn("local", F.coalesce(F.sum("windows").over(running), F.lit(0))).join(firsts, ["part", "bin"])
    bin_base = F.get(F.array(*(F.lit(int(x)) for x in base + np.cumsum(windows) - windows)), F.col("bin"))
    whole = whole.select("part", "row", F.posexplode(F.sequence(F.lit(0), (F.col("windows") - 1).cast("int"))).alias("i", "_i"), (bin_base + F.col("first_window") + F.col("local")).alias("s"))
    whole = whole.select("part", "row", (F.col("i") * F.lit(WINDOW).cast("long")).alias("start"), F.lit(WINDOW).cast("long").alias("length"), (F.col("s") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("slot"))
    placed_all = placed.where("sequence_id >= 0").unionByName(laid)
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed_all.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).drop("slot").unionByName(whole.withColumn("offset", F.lit(0).cast("long")).drop("slot"))
    places = offsets.groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    return tokens.join(places, ["part", "row"]).select("doc_id", "doc_tokens", "ids", "places").mapInArrow(_pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
