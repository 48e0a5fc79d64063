"""Posting lists: coding, skips, conjunctions against scans, additions and what a search reads."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marigold.operators import posting_index as P
from marigold.operators import search


def a_list(numbers: list[int]) -> P.PostingList:
    x = np.array(numbers, np.int64)
    data, _, lasts, ends, _ = P.encoded(x, np.array([0, len(x)]))
    return P.PostingList(data, lasts, ends, len(x))


def test_lists_come_back_from_their_bytes():
    rnd = random.Random(3)
    lists = [sorted(rnd.sample(range(top), n)) for top, n in ((1, 1), (200, 128), (300, 129), (1 << 40, 700), (5000, 5000), (10, 0), (1 << 20, 257))]
    x, cuts = np.array([n for one in lists for n in one], np.int64), np.cumsum([0, *map(len, lists)])
    data, bounds, lasts, ends, blocks = P.encoded(x, cuts)
    assert np.array_equal(P.decoded(data, np.diff(cuts)), x)
    for i, one in enumerate(lists):
        own = data[bounds[i] : bounds[i + 1]]
        assert P.decoded(own).tolist() == one
        assert lasts[blocks[i] : blocks[i + 1]].tolist() == [one[min(a + P.BLOCK, len(one)) - 1] for a in range(0, len(one), P.BLOCK)]
        assert not one or ends[blocks[i + 1] - 1] == len(own)


def test_lists_meet_through_skip_entries():
    rnd = random.Random(8)
    sets = [sorted(rnd.sample(range(200_000), n)) for n in (40, 3000, 90_000)]
    sets[0] = sorted({*sets[0], *rnd.sample(sorted(set(sets[1]) & set(sets[2])), 5)})
    lists = [a_list(s) for s in sets]
    assert P.common(lists).tolist() == sorted(set(sets[0]) & set(sets[1]) & set(sets[2])) != []
    _, read = lists[2].among(np.array(sets[0]))
    assert read <= len(sets[0]) < len(lists[2].lasts) / 10
    assert P.common([a_list([1, 2]), a_list([3])]).tolist() == [] and P.common([a_list([7])]).tolist() == [7]
    assert a_list([5]).among(np.array([9, 10]))[0].tolist() == []


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    words = ["common", "often", *(f"w{i}" for i in range(400))]
    rows = [(i, " ".join(["Common", *rnd.choices(words[1:], weights=[200, *[1] * 400], k=30)]) + (" \trare  word" if i % 97 == 0 else "")) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, "common rare"), (7, "common rare second row of id seven"), (2003, "common " * 30_000 + "rare")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("segment_docs", [64, 5000])
def test_conjunctions_equal_the_scan(spark, corpus, tmp_path, segment_docs):
    index = P.PostingIndex(spark, str(tmp_path / "p"))
    for part in ("doc_id % 3 = 0", "doc_id % 3 <> 0 OR doc_id IS NULL"):
        P.add(index, corpus.where(part), segment_docs=segment_docs, dimensions=64)
    for words in (["rare"], ["common", "RARE"], ["common", "often", "w3"], ["w1", "w2"], ["absent"], ["common", "absent"], [], ["common", "common"], [f"w{i}" for i in range(15)]):
        want = sorted((r.doc_id for r in search.keyword_filter(corpus, words).collect()), key=str)
        assert sorted((r.doc_id for r in P.holding_all(index, words).collect()), key=str) == want, words
    known = corpus.where("doc_id IS NOT NULL")
    want = search.hybrid(known, ["common", "w5"], "common w5 w6", 20).collect()
    got = [r for r in P.hybrid(index, ["common", "w5"], "common w5 w6", 20).collect() if r.doc_id is not None]
    assert [r.score for r in got] == [r.score for r in want] and len({r.doc_id for r in got} ^ {r.doc_id for r in want}) <= 2


def test_additions_and_what_a_search_reads(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "ROW_GROUP", 2000)
    index = P.PostingIndex(spark, str(tmp_path / "p"))
    P.add(index, corpus.where("doc_id < 700"))
    before = set(index.lists().inputFiles())
    P.add(index, corpus.where("doc_id >= 700 AND doc_id <> 7"))
    assert before < set(index.lists().inputFiles())
    assert index.lists().groupBy("segment", "word").count().where("count > 1").isEmpty()
    assert "EqualTo(word,rare)" in P.holding_all(index, ["rare"])._jdf.queryExecution().toString()
    groups = duckdb.connect().sql(f"SELECT stats_min_value, stats_max_value FROM parquet_metadata('{tmp_path}/p/lists/*.parquet') WHERE path_in_schema = 'word'").fetchall()
    assert sum(a <= "rare" <= b for a, b in groups) < len(groups) / 2  # ranges of words tell the row groups apart
    empty = P.add(P.PostingIndex(spark, str(tmp_path / "e")), corpus.where("doc_id = -1"))
    assert P.holding_all(empty, ["rare"]).collect() == [] and P.holding_all(P.add(empty, corpus.where("doc_id = 97")), ["rare"]).agg(F.max("doc_id")).first()[0] == 97
