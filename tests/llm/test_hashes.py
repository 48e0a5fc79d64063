"""Hashes of spans, and what passes let go before they begin."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from marigold.llm import common, ngram_join, packing


def test_span_hashes_do_not_depend_on_steps(monkeypatch):
    rnd = random.Random(1)
    data = np.frombuffer(rnd.randbytes(20_000), np.uint8)
    cut = sorted(rnd.sample(range(20_000), 60))
    starts, ends = np.array([0, 5, *cut[::2], 7000]), np.array([0, 5, *cut[1::2], 19_000])
    codes = np.random.default_rng(2).integers(0, 1 << 63, 256).astype(np.uint64)
    want = common.span_hashes(data, starts, ends, codes)
    assert (common.span_hashes(codes[data], starts, ends) == want).all()
    monkeypatch.setattr(common, "STEP", 64)
    assert (common.span_hashes(data, starts, ends, codes) == want).all()
    alone = [common.span_hashes(data[a:b], np.array([0]), np.array([b - a]), codes)[0] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert alone == want.tolist()


def test_long_words_that_differ_at_many_places_stay_apart():
    """Words of 1,024 letters after Thue and Morse had one hash, whatever the codes of their letters."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
        first, second = ngram_join.shingle_sets(pa.RecordBatch.from_pydict({"text": [a, b]}), 3)
        assert first.tolist() != second.tolist()


def test_passes_let_go_what_other_modules_keep(monkeypatch):
    calls = []
    assert common.KEPT[packing.__name__] == packing._cache.cache_clear
    monkeypatch.setattr(common, "KEPT", {__name__: lambda: calls.append("own"), "elsewhere": lambda: calls.append("other")})

    @common.tidy
    def step(batches):
        yield from batches

    assert list(step([1, 2])) == [1, 2] and calls == ["other"]
