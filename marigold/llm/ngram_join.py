"""Exact Jaccard self-join of word n-gram sets, by a grouped prefix join.

Sets: distinct `shingle`-word sequences of the text with A-Z lower-cased, words [^\\x20\\x09-\\x0D]+; with fewer words, all of them as
one; without words, none. Two sets link when 100 * intersection >= percent * union.

1. Documents with equal sets are one class. Shingles are ordered globally, rare ones first, by a sketch of their document
   frequencies (any order gives the same result; this one keeps common passages out of prefixes).
2. Linked sets share a shingle in their prefixes of size - ceil(percent * size / 100) + 1 shingles. Classes with identical prefixes
   and sizes collapse into one group. Only prefix shingles that a twice-seen Bloom filter suspects are shuffled. The groups of a
   shingle that at most LIST groups hold meet as pairs; group pairs pass a length filter, a positional filter at their first common
   prefix shingle, and a count filter: with c common prefix shingles, at most c and the longer rest behind a prefix can be common.
   A shingle of more groups emits no pairs: it ties the groups of one size class to their smallest one, a star.
3. Group pairs and stars only say which groups must meet: their connected components are dealt to tasks, up to BLOCK classes of a
   component in one task, larger components in tasks of two blocks each, every pair of blocks once. There groups expand to their
   classes and whole sets. Group pairs pass the same filters on their whole prefixes, also those that only a star brought together;
   members of the pairs that are left are verified, exact intersections coming from products of 0/1 matrices over a few thousand
   shingles at a time. No pair leaves a task: what does is each class's number of links and its smallest linked class.
4. Connected components of those give the result.

Defined results: documents without words link with nothing; null ids count as documents, and component_id is null only if every
id of the component is; rows of equal id and different text are nodes of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigold.llm import bloom, sketch
from marigold.llm.common import buffers, gram_hashes, mix, release, slices, tidy, word_hashes, word_spans
from marigold.operators.graph import connected_components
from marigold.lineage import dropped, written

BLOCK, COLUMNS = 512, 4096
#: Groups of a prefix shingle that meet as pairs; at most LIST / 2 pairs come from each place in a prefix.
LIST = 32
#: Pairs that a vectorised step handles at once.
PAIRS = 1 << 19
#: Counters of the frequency sketch: about one for 16 shingles, within these bounds.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 24


def shingle_sets(piece: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """Each document's set as sorted distinct 64-bit hashes."""
    data, offsets = buffers(piece.column("text"))
    starts, ends, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    grams, out = gram_hashes(words, shingle, 3), []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a, 1000 + b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch], shingle: int, counters: int) -> np.ndarray:
    counts = np.zeros(counters, np.uint32)
    for batch in batches:
        for piece in slices(batch):
            release()
            at, n = np.unique(np.concatenate(shingle_sets(piece, shingle)) & np.uint64(counters - 1), return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.uint32)
    return counts


def ordered(s: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """A set in the global order: by frequency, then hash."""
    return s[np.lexsort((s, frequencies[(s & np.uint64(len(frequencies) - 1)).astype(np.int64)]))]


def prefix_of(s: np.ndarray, frequencies: np.ndarray, percent: int) -> np.ndarray:
    """The set's first size - ceil(percent * size / 100) + 1 shingles in the global order."""
    n = len(s)
    return ordered(s, frequencies)[: n - -(-percent * n // 100) + 1] if n else s


def _prefix_hashes(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, frequencies: Broadcast) -> Iterator[np.ndarray]:
    for batch in batches:
        for piece in slices(batch):
            release()
            for s in shingle_sets(piece, shingle):
                yield prefix_of(s, frequencies.value, percent)


def _digest(*parts: np.ndarray) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p.tobytes())
    return h.digest()


@tidy
def _described(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, frequencies: Broadcast, twice: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per document: size and digest of the set, number of the group with this prefix and size, and the suspected prefix shingles,
    each with its place in the prefix."""
    for batch in batches:
        for piece in slices(batch):
            release()
            sets = shingle_sets(piece, shingle)
            prefixes = [prefix_of(s, frequencies.value, percent) for s in sets]
            edges = np.cumsum([0, *map(len, prefixes)])
            hit = twice.value(np.concatenate(prefixes))
            groups = [int.from_bytes(_digest(np.array([len(s)]), p)[:8], "little", signed=True) if len(s) else None for s, p in zip(sets, prefixes, strict=True)]
            prefix = [p[hit[a:b]].tobytes() + np.flatnonzero(hit[a:b]).astype(np.uint32).tobytes() for p, a, b in zip(prefixes, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(groups, pa.int64()), pa.array(prefix, pa.binary())],
                ["doc_id", "h", "n", "fp", "g", "prefix"],
            )


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets whose sizes pass the length filter are in equal or adjacent classes."""
    return np.floor(np.log(n) / (np.log(100 / percent) * (1 + 1e-9) + 1e-9)).astype(np.int64)


@tidy
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each suspected prefix shingle of a group: (token, g, n, at, hot), from rows (g, n, hot, prefix)."""
    for batch in batches:
        content = [x.as_buffer() for x in batch.column("prefix")]
        if not content:
            continue
        each = [len(x) // 12 for x in content]
        tokens = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(content, each, strict=True)])
        places = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(content, each, strict=True)])
        groups, sizes, hot = (np.repeat(np.asarray(batch.column(c)), each) for c in ("g", "n", "hot"))
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(groups, pa.int64()), pa.array(sizes, pa.int32()), pa.array(places, pa.int32()), pa.array(hot, pa.int32())], ["token", "g", "n", "at", "hot"])


def _classed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, g, n) under a key of the shingle and the group's size class, and of the next class: sizes that can link meet in one."""
    for batch in batches:
        token, classes = np.asarray(batch.column("token")).view(np.uint64), size_class(np.asarray(batch.column("n")), percent)
        for step in (0, 1):
            key = mix(token + (classes + step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("g")], ["token", "g"])


def least_common(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def rest_of(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles stand behind the prefix of a set of this size."""
    return -(-percent * n // 100) - 1


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Group pairs of each shingle's list that pass the length filter: (a, b, need, room). need: how many common prefix shingles the
    pair must have; room: what the positional filter leaves if this shingle is the pair's first, at least 0 for a candidate.
    Shingles of long lists are not met here, so they count as common as often as both groups hold any."""
    for batch in batches:
        lists = batch.column(0)
        lengths, flat = np.asarray(lists.value_lengths()), lists.flatten()
        g, n, at, hot = (np.asarray(flat.field(c)).astype(np.int64) for c in ("g", "n", "at", "hot"))
        firsts = np.cumsum(lengths) - lengths
        for k in np.unique(lengths).tolist():
            i, j = np.triu_indices(k, 1)
            chosen = firsts[lengths == k]
            step = max(1, PAIRS // max(1, len(i)))
            for c in range(0, len(chosen), step):
                x, y = (chosen[c : c + step, None] + i).reshape(-1), (chosen[c : c + step, None] + j).reshape(-1)
                fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[fits], y[fits]
                need, free = least_common(n[x], n[y], percent), np.minimum(hot[x], hot[y])
                room = np.minimum(n[x] - at[x], n[y] - at[y]) + free - need
                least = np.maximum(1, need - free - np.maximum(rest_of(n[x], percent), rest_of(n[y], percent)))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g[x], g[y])), pa.array(np.maximum(g[x], g[y])), pa.array(least, pa.int32()), pa.array(room, pa.int32())], ["a", "b", "need", "room"])


@tidy
def _wanted(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts (h, text) whose hash may be a candidate's; of equal ones that meet in a task, one."""
    seen: set[int] = set()
    for batch in batches:
        h = np.asarray(batch.column(0))
        keep = []
        for i in np.flatnonzero(held.value(mix(h.view(np.uint64)))).tolist():
            if (x := int(h[i])) not in seen:
                seen.add(x)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


@tidy
def _expanded(batches: Iterator[pa.RecordBatch], shingle: int, frequencies: Broadcast) -> Iterator[pa.RecordBatch]:
    """The whole sets of candidate classes, in the global order; of equal texts that meet in a partition, one."""
    seen: set[bytes] = set()
    names = ["fp", "component", "blocks", "block"]
    for batch in batches:
        keep = []
        for i, fp in enumerate(batch.column(0).to_pylist()):
            if fp not in seen:
                seen.add(fp)
                keep.append(i)
        for piece in slices(batch.take(pa.array(keep, pa.int64()))):
            sets = [ordered(s, frequencies.value).tobytes() for s in shingle_sets(piece, shingle)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])


def products(sets: list[np.ndarray], m: int, square: bool) -> np.ndarray:
    """Intersection sizes of the first m sets with each other (square), or with the others."""
    sizes = [len(s) for s in sets]
    hashes, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(columns, minlength=len(hashes)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[columns]
    rows, columns = rows[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((m, m if square else len(sets) - m), np.float32)
    total = int(shared.sum())
    for c in range(0, total, COLUMNS):
        a, b = np.searchsorted(columns, [c, c + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, total - c)), np.float32)
        x[rows[a:b], columns[a:b] - c] = 1
        common += x[:m] @ (x if square else x[m:]).T
    if square:  # what a set has alone is common to it and itself
        np.fill_diagonal(common, sizes[:m])
    return common.astype(np.int64)


def links_between(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int) -> np.ndarray:
    """Pairs (i, j) of set numbers that link: all pairs within `left`, or, with `right`, all pairs across. Sets are in the global order.

    Sets of one prefix and size are a group; group pairs pass the length and count filters, and their members are verified."""
    square = right is None
    members = left if square else np.concatenate([left, right])
    m = len(left)
    groups: dict[tuple[int, bytes], int] = {}
    prefixes, of = [], np.empty(len(members), np.int64)
    for k, i in enumerate(members.tolist()):
        if k == m:
            groups = {}  # the right side has groups of its own
        n = len(sets[i])
        prefix = sets[i][: n - int(rest_of(np.int64(n), percent))]
        of[k] = groups.setdefault((n, prefix.tobytes()), len(prefixes))
        if of[k] == len(prefixes):
            prefixes.append(prefix)
    sizes = np.array([len(sets[i]) for i in members], np.int64)
    size_of = np.empty(len(prefixes), np.int64)
    size_of[of] = sizes
    edge = len(prefixes) if square else int(of[:m].max()) + 1
    si, sj = size_of[:edge, None], (size_of if square else size_of[edge:])[None, :]
    fits = 100 * np.minimum(si, sj) >= percent * np.maximum(si, sj)
    fits &= products(prefixes, edge, square) >= least_common(si, sj, percent) - np.maximum(rest_of(si, percent), rest_of(sj, percent))
    own, other = of[:m], of if square else of[m:] - edge
    some = np.flatnonzero(fits.any(1)[own])
    others = some if square else np.flatnonzero(fits.any(0)[other])
    if not len(some) or not len(others):
        return np.zeros((0, 2), np.int64)
    a, b = left[some], (left if square else right)[others]
    common = products([sets[i] for i in (a if square else np.concatenate([a, b])).tolist()], len(a), square)
    ni, nj = np.array([len(sets[i]) for i in a], np.int64)[:, None], np.array([len(sets[i]) for i in b], np.int64)[None, :]
    fine = fits[own[some][:, None], other[others][None, :]] & (100 * common >= percent * (ni + nj - common))
    if square:
        fine &= np.arange(len(a))[:, None] < np.arange(len(a))[None, :]
    i, j = np.nonzero(fine)
    return np.stack([a[i], b[j]], 1)


def _verified(table: pa.Table, percent: int) -> pa.Table:
    """(fp, component, blocks, links, root): links of each class within the task, and the smallest class it reaches by them."""
    fps, component, blocks, block = (table[c].to_pylist() for c in ("fp", "component", "blocks", "block"))
    b1, b2 = table["b1"].to_pylist(), table["b2"].to_pylist()
    content = table["shingles"].combine_chunks() if table.num_rows else None
    sets: list[np.ndarray] = []
    work: dict[tuple, list[int]] = {}
    known: set[tuple] = set()
    for i in range(table.num_rows):
        sets.append(np.frombuffer(content[i].as_buffer(), np.uint64))
        key = (component[i], b1[i], b2[i])
        if (key, fps[i]) not in known:
            known.add((key, fps[i]))
            work.setdefault(key, []).append(i)
    links: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (_, first, second), members in work.items():
        left = np.array([i for i in members if block[i] == first], np.int64)
        right = None if first == second else np.array([i for i in members if block[i] == second], np.int64)
        if len(left) < (2 if right is None else 1) or (right is not None and not len(right)):
            continue
        for i, j in links_between(sets, left, right, percent).tolist():
            links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b, key=fps.__getitem__)] = min(a, b, key=fps.__getitem__)
    found = sorted(links)
    return pa.Table.from_arrays(
        [pa.array([fps[i] for i in found], pa.binary()), pa.array([blocks[i] for i in found], pa.int64()), pa.array([links[i] for i in found], pa.int64()), pa.array([fps[root(i)] for i in found], pa.binary())],
        names=["fp", "blocks", "links", "root"],
    )


def _verifier(percent: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _verified(table, percent)


def candidate_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): group pairs that pass the filters, and stars of the groups that share a shingle of a long list. groups: (g, n, prefix)."""
    schema = "token long, g long, n int, at int, hot int"
    postings = groups.select("g", "n", F.lit(0).alias("hot"), "prefix").mapInArrow(_postings, schema)
    long = written(postings.groupBy("token").agg(F.count("*").alias("groups")).where(F.col("groups") > LIST).select("token"), "long")
    far = written(postings.join(long, "token", "left_semi").select("token", "g", "n"), "far")
    hot = far.groupBy("g").agg(F.count("*").cast("int").alias("hot"))
    near = groups.join(hot, "g", "left").select("g", "n", F.coalesce("hot", F.lit(0)).alias("hot"), "prefix").mapInArrow(_postings, schema)
    near = written(near.join(long, "token", "left_anti"), "near")  # a table, so that the join with a hot key can be split
    lists = near.groupBy("token").agg(F.collect_list(F.struct("g", "n", "at", "hot")).alias("groups")).where(F.size("groups") > 1)  # at most LIST groups each
    met = lists.select("groups").mapInArrow(partial(_pairs, percent=percent), "a long, b long, need int, room int")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.max("need").alias("need"), F.max("room").alias("room")).where("common >= need AND room >= 0")
    ties = written(far.mapInArrow(partial(_classed, percent=percent), "token long, g long"), "ties")
    stars = written(ties.groupBy("token").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least < most").select("token", "least"), "stars")
    tied = ties.join(stars, "token").where("g <> least").select(F.col("least").alias("a"), F.col("g").alias("b")).distinct()
    return pairs.select("a", "b").unionByName(tied)


def linked_components(docs: DataFrame, *, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, h, n_shingles, component_id, n_links, root). component_id is the smallest id reachable by links;
    n_links counts the different sets that the document's set links with; h is the hash of the text; root tells components apart, also
    where ids repeat, and is null without words."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    texts = slim.select("text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    share = spark.sparkContext.broadcast
    counters = int(min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << int(size / 6 / 16).bit_length())))
    counts = sketch.summed(texts, partial(_frequencies, shingle=shingle, counters=counters), counters)
    frequencies = share(np.minimum(counts, 65535).astype(np.uint16))
    common = {"shingle": shingle, "percent": percent, "frequencies": frequencies}
    twice = share(bloom.twice_seen(texts, partial(_prefix_hashes, **common), size / 6 * (1.02 - percent / 100)))
    sets = written(slim.mapInArrow(partial(_described, **common, twice=twice), "doc_id long, h long, n long, fp binary, g long, prefix binary"), "sets")
    held = sets.where("n > 0")
    classes = written(held.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("h").alias("h"), F.min("g").alias("g")), "classes")
    groups = written(held.groupBy("g").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).where("length(prefix) > 0"), "groups")
    components = connected_components(candidate_pairs(groups, percent), "a", "b")
    dropped(groups)
    placed = classes.join(components.withColumnRenamed("node", "g"), "g", "left").select("fp", "h", F.coalesce("component", "g").alias("component"))
    placed = written(placed, "placed")
    counts = written(placed.groupBy("component").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    candidates = written(placed.join(counts, "component").select("fp", "h", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("block")), "candidates")
    dropped(placed)
    wanted = share(bloom.holding(candidates.select("h"), candidates.count()))
    texts = slim.select("h", "text").mapInArrow(partial(_wanted, held=wanted), "h long, text string")
    expanded = texts.join(candidates, "h").select("fp", "component", "blocks", "block", "text").mapInArrow(partial(_expanded, shingle=shingle, frequencies=frequencies), "fp binary, component long, blocks long, block long, shingles binary")
    # a class meets every block of its component; components of one block share tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), candidates.where("blocks = 1").count() // BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = expanded.select("*", other.alias("other")).select("fp", "component", "blocks", "block", "shingles", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    met = met.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", "b1", "b2")))
    verified = written(met.groupBy("task").applyInArrow(_verifier(percent), "fp binary, blocks long, links long, root binary"), "links")
    links = verified.groupBy("fp").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    split = verified.where("blocks > 1")
    if not split.isEmpty():
        whole = connected_components(split.where("fp <> root").select("fp", "root"), "fp", "root").select(F.col("node").alias("fp"), "component")
        links = links.join(whole, "fp", "left").select("fp", "n_links", F.coalesce("component", "root").alias("root"))
    named = classes.join(written(links, "roots"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    result = written(named.join(least, "root").select("fp", "root", "component_id", "n_links"), "result")
    joined = sets.select("doc_id", "h", "n", "fp").join(result, "fp", "left")
    return joined.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")


def keep_one(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id; all columns stay. Of rows with that id, the one with the
    smallest text hash stays, and of rows with equal texts the first in the order of all their columns as JSON.

    All rows without words stay, repeated ones too, and so do all rows of a component whose ids are all null."""
    linked = linked_components(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col).where("n_shingles > 0 AND component_id IS NOT NULL")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    own = linked.where(first).groupBy("root").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least_id"), F.min("h").alias("least")).where("rows > 1")
    several = written(own, "several")  # components whose smallest id comes more than once
    same_id = linked.where(first).join(several, "root").where("h <> least").select("doc_id", "h")
    key = [F.col("doc_id").alias("_mg_id"), F.col("h").alias("_mg_h")]
    gone = written(linked.where(~first).select("doc_id", "h").unionByName(same_id).select(*key).distinct(), "gone")
    left = bloom.without(docs, gone, id_col=id_col, text_col=text_col)
    if several.isEmpty():
        return left
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    match = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_mg_id")) & (F.col("_mg_key") == F.col("_mg_h"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    twins = written(several.select(F.col("least_id").alias("_mg_id"), F.col("least").alias("_mg_h")), "twins")
    order = Window.partitionBy(F.col(f"`{id_col}`").cast("long"), "_mg_key").orderBy(F.to_json(F.struct(*columns)))
    one = docs.withColumn("_mg_key", F.xxhash64(text)).join(twins, match, "left_semi").withColumn("_mg_rank", F.row_number().over(order)).where("_mg_rank = 1")
    return bloom.without(left, twins, id_col=id_col, text_col=text_col).unionAll(one.select(*columns))
