"""Hilbert-curve shards, spelling variants and ranked lexical search against brute-force versions, with every edge."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marigold.llm import hilbert, oracles, postings, queries, spelling
from tests.llm import texts as T


@pytest.fixture(scope="module")
def docs(spark):
    return T.documents(spark).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -5")


@pytest.mark.parametrize("name", ["op11_hilbert", "op12_spelling", "op13_postings"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf), con.sql(oracles.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


# 11. Hilbert curve


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(spark, dims, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"x{i}" for i in range(dims)])
    index = hilbert.curve_index([F.col(f"x{i}").cast("int") for i in range(dims)], bits)
    walk = cells.select("*", index.alias("h")).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(1 << dims * bits))
    assert all(sum(abs(a - b) for a, b in zip(p[:-1], q[:-1], strict=True)) == 1 for p, q in itertools.pairwise(walk))


def cells_by_hand(values: list, bits: int) -> list[int]:
    held = sorted(v for v in values if v is not None)
    nulls = len(values) - len(held)
    return [0 if v is None else (nulls + sum(x < v for x in held)) * (1 << bits) // len(values) for v in values]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_follow_the_order_and_the_law(docs, rows, law):
    dims = ["source", "n_chars", "odd name.x"]
    sized = docs.withColumn("size", F.octet_length("text") + F.lit(1)).withColumn("hilbert", F.lit("clash")).withColumn("_rank", F.lit(3))
    got = hilbert.shards(sized, dims[:2], 5, bits=3, law=law, size_col="size", ties=("doc_id", "text")).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.text, r["odd name.x"] is None, r._rank) for r in got) == Counter((r.doc_id, r.text, r["odd name.x"] is None, 3) for r in rows)
    codes = [cells_by_hand([r[c] for r in got], 3) for c in dims[:2]]
    places = defaultdict(set)
    for r, cell in zip(got, zip(*codes, strict=True), strict=True):
        places[cell].add(r.hilbert.curve)
    assert all(len(x) == 1 for x in places.values()) and len({min(x) for x in places.values()}) == len(places)
    ordered = sorted(got, key=lambda r: (r.hilbert.curve, -1 if r.doc_id is None else r.doc_id, r.text or ""))
    assert [(r.hilbert.shard, r.hilbert.slot) for r in sorted(got, key=lambda r: (r.hilbert.shard, r.hilbert.slot))] == [(r.hilbert.shard, r.hilbert.slot) for r in ordered]
    counts = Counter(r.hilbert.shard for r in got)
    assert all(sorted(r.hilbert.slot for r in got if r.hilbert.shard == s) == list(range(n)) for s, n in counts.items())
    if law == "rows":
        assert len(counts) == 5 and max(counts.values()) - min(counts.values()) <= 1
    else:
        size = lambda r: r.size or 0
        total, largest = sum(map(size, got)), max(map(size, got))
        held = Counter()
        for r in got:
            held[r.hilbert.shard] += size(r)
        assert all(abs(held[s] - total / 5) <= largest for s in range(5))


def test_shards_of_few_rows_of_one_value_and_of_none(spark, docs, empty):
    assert hilbert.shards(empty, ["source", "n_chars"], 7).collect() == []
    few = hilbert.shards(docs.where("doc_id < 3"), ["lang", "key"], 40, ties=("doc_id", "text")).select("hilbert.*").collect()
    assert len({r.shard for r in few}) == len(few) and all(r.slot == 0 for r in few)
    same = spark.range(1000).select(F.lit(None).cast("string").alias("a"), F.lit(2.5).alias("b"), F.lit("x").alias("c"))
    sizes = hilbert.shards(same, ["a", "b", "c"], 3, law="bytes", size_col="b").groupBy("hilbert.shard").count().collect()
    assert {r["shard"]: r["count"] for r in sizes} == {0: 333, 1: 334, 2: 333} or sorted(r["count"] for r in sizes) == [333, 333, 334]
    with pytest.raises(ValueError):
        hilbert.shards(same, ["a"], 3, law="bytes")


def test_written_shards_are_pruned_by_several_dimensions(spark, sf, tmp_path):
    docs, path = spark.read.parquet(f"{sf}/orders.parquet"), str(tmp_path / "shards")
    dims = ["o_totalprice", "o_orderdate", "o_orderpriority"]
    hilbert.write_shards(hilbert.shards(docs, dims, 32, ties=("o_orderkey",)), path)
    held = hilbert.manifest(spark, path, dims).cache()
    assert held.count() == 32 and held.agg(F.sum("n_rows")).first()[0] == docs.count()
    low, high = docs.agg(F.percentile("o_totalprice", 0.4), F.percentile("o_totalprice", 0.5)).first()
    for ranges in ({"o_totalprice": (low, high)}, {"o_orderpriority": ("2", "3")}, {"o_totalprice": (low, None), "o_orderpriority": (None, "2")}):
        found = hilbert.read_shards(spark, path, held, ranges)
        want = docs
        for c, (a, b) in ranges.items():
            want = want.where(F.lit(True) if a is None else F.col(c) >= a).where(F.lit(True) if b is None else F.col(c) <= b)
        assert sorted(r.o_orderkey for r in found.collect()) == sorted(r.o_orderkey for r in want.collect())
        assert len(found.inputFiles()) >= 1
    one = held.where((F.col("high_o_totalprice") >= low) & (F.col("low_o_totalprice") <= high)).count()
    assert one < 20  # of 32, for a tenth of the rows
    con = duckdb.connect()
    assert con.sql(f"SELECT count(*) FROM '{path}/shard=*/*.parquet'").fetchall() == [(docs.count(),)]


# 12. Spelling variants


def near(a: str, b: str) -> bool:
    """One edit, by hand."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts: dict[str, int]) -> dict[str, tuple]:
    close = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(close[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(close[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("limit", [0, 6, spelling.LIMIT])
def test_variants_of_all_near_words(spark, limit):
    rnd = random.Random(limit)
    pool = {"".join(rnd.choices("abé", k=rnd.randint(1, 7))) for _ in range(300)} | {"x" * n for n in range(1, 60)} | {"shared" + a + b for a in "abcdefgh" for b in "ÿabc"}
    counts = {w: rnd.choice([1, 2, 3, 5, 9, 20, 50]) for w in sorted(pool)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), limit=limit).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == variants_by_hand(counts) and len(got) == len(counts)


def test_a_hot_segment_makes_no_square(spark):
    """3,000 words with the same first half: no key makes more than LIMIT candidates, and all near pairs are found."""
    rnd = random.Random(5)
    words = sorted({"prefixes" + "".join(rnd.choices("abcdefghijklmnop", k=8)) for _ in range(3000)} | {"prefixesabcdefg" + c for c in "abcdefghijklmnop"})
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].add(w)
    want = {(a, b) for x in cuts.values() for a in x for b in x if a < b}
    assert {tuple(sorted((r.word, r.near))) for r in pairs} == want and len(pairs) == len(want) >= 120


def test_spelling_of_documents(docs, rows, empty):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(T.LOWER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 3 and n >= 2}
    got = spelling.variants(spelling.counted(spelling.with_slips(spelling.runs(docs), 7), min_chars=3, min_count=2)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == variants_by_hand(counts)
    assert spelling.variants(spelling.counted(spelling.runs(empty))).collect() == []


# 13. Ranked lexical search


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(T.LOWER))


def ranked_by_hand(docs: list[tuple], items: list[tuple], k: int) -> Counter:
    tf = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    n_docs, total, df = sum(x > 0 for x in n), sum(n), Counter(t for c in tf for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for (doc, _), counts, size in zip(docs, tf, n, strict=True):
            score = 0
            for t in set(terms(text)):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * (50 + 50 * size * n_docs // total)))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k]):
            out[item, rank + 1, doc, -score] += 1
    return out


@pytest.mark.parametrize("shard_bytes, block", [(postings.SHARD_BYTES, 4096), (2000, 2)])
def test_ranking(spark, docs, rows, empty, monkeypatch, shard_bytes, block):
    monkeypatch.setattr(postings, "BLOCK_ITEMS", block)
    items = [(1, "one TWO three"), (1, "one TWO three"), (2, None), (3, ""), (None, "漢字 naïve été"), (5, "same line rare 3"), (6, T.PASSAGE), (7, "n1 n2 edit3 n9 n9"), (8, "not there at all xyzzy"), (9, T.LONG[:3000]), (10, "cc by one")]
    bench = spark.createDataFrame([(i, t, "x", 4) for i, t in items], "item_id long, text string, doc string, number int").repartition(2)
    index = postings.build_index(docs, shard_bytes=shard_bytes)
    got = postings.search(index, bench, k=4).collect()
    assert Counter(map(tuple, got)) == ranked_by_hand([(r.doc_id, r.text) for r in rows], items, 4)
    assert postings.search(index, bench.where("item_id = -1"), k=4).collect() == []
    assert postings.search(postings.build_index(empty), bench, k=4).collect() == []


def test_best_of_keeps_ties_by_id():
    scores, ids = np.array([5, 7, 7, 0, 7, 5, 7]), np.array([1, 9, 3, 0, 0, 2, 5])
    valid = np.array([True, True, True, True, False, True, True])
    assert postings.best_of(scores, ids, valid, 3).tolist() == [4, 2, 6] and postings.best_of(scores, ids, valid, 5).tolist() == [4, 2, 6, 1, 0]
    assert postings.best_of(scores * 0, ids, valid, 3).tolist() == []


def test_a_row_group_of_the_index_holds_few_shards(spark):
    """Parquet's writer and reader hold a row group in memory, whatever the number of shards that a task makes."""
    import pyarrow.parquet as pq

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(800)), lambda i: F.md5(F.concat_ws(" ", "id", i))), " ").alias("text"))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in postings.build_index(docs, shard_bytes=4 << 20).inputFiles()]
    sizes = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert len(sizes) > 4 and max(sizes) < 48 << 20
