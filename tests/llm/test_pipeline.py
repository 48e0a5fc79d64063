"""The pipeline, stage by stage, each on its own input, against brute-force versions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marigold.llm import quality
from tests.llm import texts as T


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    root, docs, held = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(root / name))
        out = spark.read.parquet(str(root / name))
        held[name] = (docs, out)
        docs = out
    return held


def test_stages_keep_the_columns(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages) and 4 <= len(stages) <= 5
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "packing")
    assert all(out.where("n_chars <> length(text)").isEmpty() for name, (_, out) in stages.items() if name in ("lines", "substrings"))


def test_quality(spark, sf, stages):
    before, after = (x.collect() for x in stages["quality"])
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    assert len(after) == math.ceil(len(before) * len(good) / len(labels))
    # the weights once more, a document and a gram at a time
    grams = {}
    for r in before:
        batch = pa.RecordBatch.from_arrays([pa.array([r.text], pa.string())], ["text"])
        grams[r.doc_id] = [g for g, _ in quality.features(batch)]
    shift = np.uint64(64 - quality.bits_for(sum(len(g) for families in grams.values() for g in families)))
    grams = {i: [(g >> shift).tolist() for g in families] for i, families in grams.items()}
    raw, target = Counter(), Counter()
    for i, families in grams.items():
        for g in families:
            raw.update(g)
            if i in good:
                target.update(g)
    size, total = sum(target.values()), sum(raw.values())
    own = {i: Counter(g for f in families for g in f) for i, families in grams.items()}
    ratio = {i: {g: math.log((target[g] - n * (i in good) + quality.PRIOR) / ((raw[g] - n) * size / total + quality.PRIOR)) for g, n in c.items()} for i, c in own.items()}
    mean = sum(ratio[i][g] * n for i, c in own.items() if i in good for g, n in c.items()) / size
    weights = {r.doc_id: r.weight for r in quality.classify(stages["quality"][0], spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for i, (one, two, heads) in grams.items():
        n = len(one) + len(two)
        w = quality.WEIGHT_GRAMS * (sum(ratio[i][g] for g in one + two) - mean * n) / (n + quality.SHRINK) + sum(ratio[i][g] for g in one + heads if ratio[i][g] < quality.TAIL)
        assert weights[i] == pytest.approx(w, abs=0.01)


def test_lines(stages):
    before, after = (x.orderBy("doc_id").collect() for x in stages["lines"])
    bad, seen, want = T.dropped_lines([r.text for r in before], 10), set(), {}
    for r in before:
        kept = []
        for line, key in zip((r.text or "").split("\n"), T.line_keys(r.text), strict=True):
            if key not in bad or key not in seen:
                kept.append(line)
            if key in bad:
                seen.add(key)
        want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in after} == want


def test_near_duplicates(stages):
    before, after = (x.orderBy("doc_id").collect() for x in stages["near_duplicates"])
    roots = T.components([r.text for r in before], 5, 80)
    assert [r.doc_id for r in after] == [r.doc_id for i, r in enumerate(before) if roots[i] == i]


def test_substrings(stages):
    before, after = (x.orderBy("doc_id").collect() for x in stages["substrings"])
    assert [T.words(r.text) for r in after] == T.uncovered([r.text for r in before], 35)


def test_packing(stages):
    before, pieces = (x.collect() for x in stages["packing"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own, filled = defaultdict(list), Counter()
    for p in pieces:
        own[p.doc_id].append(p)
        filled[p.sequence_id] += p.length
    for r in before:
        ids, at = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(own[r.doc_id], key=lambda p: p.start):
            assert p.start == at and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    assert max(filled.values()) <= 2048 and sum(2048 - n for n in filled.values()) < 0.1 * sum(filled.values())


def test_run_applies_all_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first()
    assert got == stages["packing"][1].agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first()
