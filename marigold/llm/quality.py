"""A quality classifier by importance resampling.

Two generative models over hashed n-grams: the target model from labelled good documents (a bounded sample of labels, MAX_LABELS rows
with the smallest hash of their id), the raw model from every document of the corpus. Grams are counted by BUCKETS hash buckets for
each gram of the corpus, rounded to powers of two, so the models grow with the corpus and hardly any two grams share a count at any
size. A gram's log ratio is log((target count + s) / (expected count + s)), the expected count being the raw count scaled to the
target's size, so that rare grams say little. A document's own grams are taken out of both models before it is weighed: labelled
documents have no advantage over others.

A document's log importance weight is the log ratio of the two models over its text, tempered so that length alone does not decide:
words and bigrams count as WEIGHT_GRAMS of them with the document's mean log ratio (less the target's own mean), however many they
are. Words and word beginnings that the target all but lacks (log ratio under TAIL) count in full, so that a few bad words decide in a
long text. Beginnings of words stand for their inflected forms.

Chunks of whole documents send their distinct grams with their counts to groups by ranges of the hash; a group sums the counts over
all chunks and answers each chunk, where weights are put together. A group holds its rows compressed, and one count for each bucket.

Documents are then sampled without replacement by Gumbel top-k: weight / temperature plus Gumbel noise, the k largest stay. At
temperature 1 the draw follows the weights, and noise decides among documents whose weights differ by a few units; a higher one lets
more noise in. The noise comes from a hash of seed, id and text, so a rerun draws the same. k is the share of good among the sampled
labels times the number of documents. The k-th largest is found by narrowing a histogram, never by a global sort.

Defined results: null and empty texts have weight 0 as a mean and stay in the draw; a document's label is its first by (quality,
toxic); without labels every document stays; ties at the k-th place go to the smaller id, then the smaller text hash, and equal
rows are kept or dropped together, so that ties of equal rows may exceed k.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigold.llm import bloom, chunks
from marigold.llm.common import buffers, gram_hashes, mix, release, slices, within_rows, word_hashes, word_spans
from marigold.lineage import dropped, written

PRIOR = 4.0
#: Grams of the corpus's text, repeats included, to a group; hash buckets to a gram; text of a chunk.
GROUP, BUCKETS, CHUNK_BYTES = 1 << 24, 64, 16 << 20
MAX_LABELS, WEIGHT_GRAMS, SHRINK, TAIL, BEGINNING = 100_000, 100.0, 50, -2.0, 4
#: Counts that a group merges at a time.
MERGED = 1 << 21


def features(batch: pa.RecordBatch | pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unigrams, bigrams and word beginnings: (64-bit hash of each, how many each row has)."""
    data, offsets = buffers(batch.column("text"))
    starts, ends, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    firsts, pairs = within_rows(rows, 2)
    long = ends - starts > BEGINNING + 1
    heads = word_hashes(data, starts[long], starts[long] + BEGINNING, lower=True)
    counted = np.diff(np.concatenate([[0], np.cumsum(long)])[rows])
    return [(mix(words), np.diff(rows)), (gram_hashes(words, 2, 2)[firsts], pairs), (mix(heads + np.uint64(12345)), counted)]


def _known(table: pa.RecordBatch | pa.Table, ids: np.ndarray) -> np.ndarray:
    """Which rows are labelled good."""
    return np.isin(table.column("doc_id").fill_null(-1).to_numpy(), ids) & np.asarray(table.column("doc_id").is_valid())


def _sizes(batches: Iterator[pa.RecordBatch], good: Broadcast) -> Iterator[pa.RecordBatch]:
    """How many grams an input partition has, and how many in good documents."""
    raw = target = 0
    for batch in batches:
        for piece in slices(batch):
            starts, ends, rows = word_spans(*buffers(piece.column("text")))
            words = np.diff(rows)
            n = words + np.maximum(words - 1, 0) + np.diff(np.concatenate([[0], np.cumsum(ends - starts > BEGINNING + 1)])[rows])
            raw, target = raw + int(n.sum()), target + int(n[_known(piece, good.value)].sum())
    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.int64()), pa.array([target], pa.int64())], ["raw", "target"])


def bits_for(grams: int) -> int:
    """Bits of the hash that number BUCKETS buckets to a gram."""
    return min(48, max(16, (BUCKETS * grams).bit_length()))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The hashes of all parts in order, each once, sorted in place: np.unique would hold two copies more."""
    h = np.concatenate([np.zeros(0, np.uint64), *parts])
    h.sort()
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


class Grams:
    """A chunk's distinct grams in order of their hash, the edges of each group's range, and the grams of each slice of documents."""

    def __init__(self, table: pa.Table, groups: int, bits: int, good: np.ndarray | None = None):
        """With the ids of good documents, only counts are made, in all (raw) and in good documents (target), and no slices."""
        self.pieces = [piece for batch in table.to_batches() for piece in slices(batch)]
        self.bases = -(-(np.arange(groups + 1, dtype=object) << bits) // groups)
        if good is None:
            self._read(bits)
        else:
            self._count(bits, good)
        self.edges = np.searchsorted(self.hashes, self.bases[:-1].astype(np.uint64)).tolist() + [len(self.hashes)]

    def _count(self, bits: int, good: np.ndarray) -> None:
        shift, found = np.uint64(64 - bits), []
        for piece in self.pieces:
            known, families = _known(piece, good), features(piece)
            u, raw = np.unique(np.concatenate([g for g, _ in families]) >> shift, return_counts=True)
            some, n = np.unique(np.concatenate([g[np.repeat(known, sizes)] for g, sizes in families]) >> shift, return_counts=True)
            found.append((u, raw.astype(np.uint32), some, n.astype(np.uint32)))  # few grams are in good documents
        self.pieces = []
        self.hashes = _distinct([f[0] for f in found])
        self.raw, self.target = np.zeros(len(self.hashes), np.uint32), np.zeros(len(self.hashes), np.uint32)
        while found:
            u, raw, some, n = found.pop()
            self.raw[np.searchsorted(self.hashes, u)] += raw
            self.target[np.searchsorted(self.hashes, some)] += n

    def _read(self, bits: int) -> None:
        found, distinct = [], []
        for piece in self.pieces:
            some = [(g >> np.uint64(64 - bits), n) for g, n in features(piece)]
            u, numbers = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
            distinct.append(u)
            found.append((numbers.astype(np.int32), [len(g) for g, _ in some], [n for _, n in some]))
        self.hashes = _distinct(distinct)
        self.slices = []
        for u, (numbers, sizes, counts) in zip(distinct, found, strict=True):
            numbers = np.searchsorted(self.hashes, u).astype(np.int32)[numbers]
            self.slices.append((np.split(numbers, np.cumsum(sizes)[:-1]), counts))

    def asked(self) -> list[int]:
        return [g for g, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)) if b > a]


def _planes(x: np.ndarray) -> bytes:
    """Integers with their bytes by significance, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _whole(content: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    """What _planes made."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(content, np.uint8, size * n, at).reshape(size, n).T).view(kind).reshape(-1)


def _sent(batches: Iterator[pa.RecordBatch], good: Broadcast, groups: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct grams, one row per group: differences of the hashes, counts in all and in good documents."""
    for batch in batches:
        for chunk, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams = Grams(chunks.unpacked(block.as_buffer()), groups, bits, good.value)
            raw, target, rows = grams.raw, grams.target, []
            for g in grams.asked():
                some = slice(grams.edges[g], grams.edges[g + 1])
                h = grams.hashes[some]
                content = _planes(np.diff(h, prepend=np.uint64(grams.bases[g]))) + _planes(raw[some]) + _planes(target[some])
                rows.append((g, chunk, chunks.checksum(h), len(h), chunks.squeezed(content)))
            del grams
            release()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["group", "chunk", "checksum", "n", "grams"])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Counts (hash, raw, target) summed by hash."""
    h, numbers = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [(h, *(np.bincount(numbers, np.concatenate([p[i] for p in parts]), len(h)).astype(np.int64) for i in (1, 2)))]  # exact below 2**53


def _summed(table: pa.Table) -> pa.Table:
    """A group's answer to each chunk: its grams' counts over all chunks. Hashes count from the group's base."""
    release()
    rows, held, n_held = list(zip(table["n"].to_pylist(), table["grams"], strict=True)), [], 0
    for n, content in rows:
        content = chunks.spread(content.as_buffer())
        held.append((np.cumsum(_whole(content, np.uint64, n), dtype=np.uint64), _whole(content, np.uint32, n, 8 * n), _whole(content, np.uint32, n, 12 * n)))
        n_held += n
        if n_held > MERGED:
            held, n_held = _merged(held), 0
    (distinct, raw, target), answers = _merged(held)[0], []
    for n, content in rows:
        at = np.searchsorted(distinct, np.cumsum(_whole(chunks.spread(content.as_buffer()), np.uint64, n), dtype=np.uint64))
        answers.append(chunks.squeezed(_planes(raw[at]) + _planes(target[at])))
    release()
    return pa.Table.from_arrays([table["group"], table["chunk"], table["checksum"], table["n"], pa.array(answers, pa.binary())], names=["group", "chunk", "checksum", "n", "counts"])


_PARTS = "doc_id long, h long, total double, grams long, tail double, target decimal(38,0)"
_UNIT = 1e9


def _parts(blocks: pa.Table, answers: pa.Table, good: Broadcast, groups: int, bits: int, size: int, scale: float) -> pa.Table:
    """Per document: sum of the log ratios of words and bigrams, their number, sum of strongly negative ratios, and its share in the
    target's sum of log ratios in units of 1 / _UNIT, whole so that sums do not depend on their order."""
    release()
    if not blocks.num_rows:
        raise RuntimeError("an answer without its chunk: the input changed between two scans")
    grams = Grams(chunks.unpacked(blocks["block"][0].as_buffer()), groups, bits)
    raw, target, missing = np.zeros(len(grams.hashes), np.int64), np.zeros(len(grams.hashes), np.int64), set(grams.asked())
    for g, check, n, content in zip(*(answers[c] for c in ("group", "checksum", "n", "counts")), strict=True):
        g, n = g.as_py(), n.as_py()
        some = slice(grams.edges[g], grams.edges[g + 1])
        if g not in missing or n != some.stop - some.start or check.as_py() != chunks.checksum(grams.hashes[some]):
            raise RuntimeError("the answer to a chunk does not fit its grams: the input changed between two scans")
        missing.discard(g)
        content = chunks.spread(content.as_buffer())
        raw[some], target[some] = _whole(content, np.int64, n), _whole(content, np.int64, n, 8 * n)
    if missing:
        raise RuntimeError("a chunk has grams without an answer: the input changed between two scans")
    out = []
    for piece, (families, counts) in zip(grams.pieces, grams.slices, strict=True):
        n = piece.num_rows
        total, count, tail, whole = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        known, numbers = _known(piece, good.value), np.concatenate(families)
        row = np.concatenate([np.repeat(np.arange(n), sizes) for sizes in counts])
        _, place, own = np.unique(row * len(raw) + numbers, return_inverse=True, return_counts=True)
        own = own[place]
        logs = np.log((target[numbers] - own * known[row] + PRIOR) / ((raw[numbers] - own) * scale + PRIOR)) if size else np.zeros(len(numbers))
        for i, (a, b) in enumerate(itertools.pairwise(np.cumsum([0, *map(len, families)]).tolist())):
            at, some = row[a:b], logs[a:b]
            whole += np.bincount(at, some, n)
            if i < 2:
                total += np.bincount(at, some, n)
                count += counts[i]
            if i != 1:
                tail += np.bincount(at, np.where(some < TAIL, some, 0.0), n)
        share = pa.array(np.round(np.where(known, whole, 0.0) * _UNIT).astype(np.int64)).cast(pa.decimal128(38, 0))
        out.append(pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), pa.array(total), pa.array(count), pa.array(tail), share], names=["doc_id", "h", "total", "grams", "tail", "target"]))
    return pa.Table.from_batches(out)


def gumbel(ids: np.ndarray, hashes: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise of documents by id and text hash."""
    h = mix(mix(hashes.astype(np.uint64) + np.uint64(seed)) + ids.astype(np.uint64))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)))


def _weighed(batches: Iterator[pa.RecordBatch], mean: float, seed: int, temperature: float) -> Iterator[pa.RecordBatch]:
    for piece in batches:
        total, count, tail = (np.asarray(piece.column(c)) for c in ("total", "grams", "tail"))
        w = np.round(WEIGHT_GRAMS * (total - mean * count) / (count + SHRINK) + tail, 6)
        noise = gumbel(piece.column("doc_id").fill_null(-1).to_numpy(), np.asarray(piece.column("h")), seed)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), pa.array(w), pa.array(w / temperature + noise)], ["doc_id", "h", "weight", "key"])


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles: a histogram of 4096 bins, narrowed until few values are left."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return low
    while low < high:
        width = (high - low) / 4096
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        if width <= 0 or low + width == low:
            break
        bins = inside.groupBy(F.least(F.lit(4095), F.floor((F.col(column) - low) / width)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["b"]):
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
        if r["n"] <= 4096:
            few = df.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()  # at most 4096 values
            return sorted((x[0] for x in few), reverse=True)[k - 1]
    return low


def classify(docs: DataFrame, labels: DataFrame, *, seed: int = 1, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, weight, key, kept): log importance weight, perturbed key and whether the document is drawn. h is the text's hash."""
    spark = docs.sparkSession
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))).alias("l"))
    sample = one.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("l.quality") == 1) & (F.col("l.toxic") == 0)).alias("good")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(MAX_LABELS).collect()
    share = sum(r["good"] for r in sample) / len(sample) if sample else 1.0
    good = spark.sparkContext.broadcast(np.array(sorted(r["doc_id"] for r in sample if r["good"]), np.int64))  # at most MAX_LABELS ids
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sized = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    raw, size = (int(x or 0) for x in slim.select("doc_id", "text").mapInArrow(partial(_sizes, good=good), "raw long, target long").agg(F.sum("raw"), F.sum("target")).first())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, bits = max(partitions, -(-raw // GROUP)), bits_for(raw)
    packed = slim.mapInArrow(partial(chunks.packed, limit=CHUNK_BYTES), chunks.SCHEMA).repartition(max(partitions, -(-sized // CHUNK_BYTES)), "chunk")  # one exchange, used twice
    sent = packed.mapInArrow(partial(_sent, good=good, groups=groups, bits=bits), "group int, chunk long, checksum long, n int, grams binary")
    counts = sent.groupBy("group").applyInArrow(_summed, "group int, chunk long, checksum long, n int, counts binary")
    parts = written(packed.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(partial(_parts, good=good, groups=groups, bits=bits, size=size, scale=size / max(1, raw)), _PARTS), name="ratios")
    mean = float(parts.agg(F.sum("target")).first()[0] or 0) / _UNIT / size if size else 0.0
    weighed = written(parts.mapInArrow(partial(_weighed, mean=mean, seed=seed, temperature=temperature), "doc_id long, h long, weight double, key double"), name="weights")
    dropped(parts)
    n = weighed.count()
    k = min(n, math.ceil(share * n))
    if not n or k == n:
        return weighed.withColumn("kept", F.lit(True))
    least = kth_largest(weighed, "key", k)
    above = weighed.where(F.col("key") > least).count()
    tied = weighed.where(F.col("key") == least).groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    if tied.count() <= 1:
        return weighed.withColumn("kept", F.col("key") >= least)
    # equal keys of different documents: by id and hash, as far as room is left
    room = tied.select("doc_id", "h", F.coalesce(F.sum("n").over(Window.orderBy(F.col("doc_id").asc_nulls_last(), "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")).where(F.col("before") < k - above).select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.lit(True).alias("drawn"))
    joined = weighed.join(room, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return joined.select("doc_id", "h", "weight", "key", ((F.col("key") > least) | ((F.col("key") == least) & F.coalesce("drawn", F.lit(False)))).alias("kept"))


def keep_drawn(docs: DataFrame, labels: DataFrame, *, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that the draw leaves out; all columns stay."""
    left_out = classify(docs, labels, seed=seed, id_col=id_col, text_col=text_col).where("NOT kept")
    gone = written(left_out.select(F.col("doc_id").alias("_mg_id"), F.col("h").alias("_mg_h")).distinct(), "gone")
    return bloom.without(docs, gone, id_col=id_col, text_col=text_col)
