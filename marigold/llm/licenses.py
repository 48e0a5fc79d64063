"""License scans by an exact set-similarity join.

A text block is a window of 2 * stride words, one starting every stride words (the last may be shorter; a shorter document is one
block). A template matches a block when at least `threshold` of the template's distinct words are in the block. Words are ordered
globally, rarest in the corpus first, over all blocks of all documents; only words of some template can count to an overlap, so
blocks are reduced to these. Prefix, length and positional filters discard pairs that cannot reach the threshold, and every pair
left is verified on the whole sets.

Templates are a parameter of bounded size (MAX_TEMPLATES, MAX_TEMPLATE_WORDS), so sending them and the order of their words to
all executors is bounded too. Base phrases are found at every place. Null and empty texts have no words and no labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TEMPLATES, MAX_TEMPLATE_WORDS = 1000, 128

# Phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences of public licences and their labels.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-2.0": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: A-Z become a-z, everything below 0x80 but 0-9 and a-z becomes a space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def blocks_of(words: list, stride: int) -> Iterator[list]:
    for start in range(0, max(1, len(words) - stride), stride):
        yield words[start : start + 2 * stride]


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[bytes]:
    for x in batch.column(i):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _block_frequencies(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes], stride: int) -> Iterator[pa.RecordBatch]:
    number, counts = {w: i for i, w in enumerate(vocabulary)}, [0] * len(vocabulary)
    known = frozenset(vocabulary)
    for batch in batches:
        for text in _texts(batch, 0):
            for block in blocks_of(words_of(text), stride):
                for w in known.intersection(block):
                    counts[number[w]] += 1
    yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], ["word", "blocks"])


class TemplateIndex:
    """Templates as sets in the global order, their prefixes listed by word."""

    def __init__(self, templates: dict[str, list[bytes]], order: dict[bytes, int], threshold: float):
        self.order, self.threshold = order, threshold
        self.labels = sorted(templates)
        self.sets = [sorted({order[w] for w in templates[x]}) for x in self.labels]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.least = min(self.need, default=1)
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for i, w in enumerate(s[: len(s) - need + 1]):
                self.lists.setdefault(w, []).append((t, i))

    def matches(self, block: list[bytes]) -> dict[int, float]:
        """Template number to containment, for those at the threshold or above."""
        order = self.order
        held = sorted({order[w] for w in order.keys() & block}) if len(block) > 64 else sorted({order[w] for w in block if w in order})
        if len(held) < self.least:
            return {}
        seen, found = set(), {}
        for j, w in enumerate(held[: len(held) - self.least + 1]):
            for t, i in self.lists.get(w, ()):
                need = self.need[t]
                if t in seen or len(held) < need or j > len(held) - need:  # length filter; beyond the block's prefix for t
                    continue
                seen.add(t)
                if 1 + min(len(self.sets[t]) - i - 1, len(held) - j - 1) < need:  # positional filter: w is the first common word
                    continue
                if (common := len(set(held).intersection(self.sets[t]))) >= need:
                    found[t] = common / len(self.sets[t])
        return found


def _phrase_starts(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """(first word's number, label) of every place of every phrase."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        at, number, before = joined.find(phrase), 0, 0
        while at >= 0:
            number, before = number + joined.count(b" ", before, at), at  # words up to here, counted on from the last place
            found.append((number, label))
            at = joined.find(phrase, at + 1)
    return found


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, list[bytes]], order: dict[bytes, int], threshold: float, stride: int, base: dict[str, str]) -> Iterator[pa.RecordBatch]:
    index = TemplateIndex(templates, order, threshold)
    phrases = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
    for batch in batches:
        rows = []
        for text in _texts(batch, 1):
            words = words_of(text)
            places, best, spans = _phrase_starts(words, phrases), {}, []
            for start, block in zip(range(0, max(1, len(words)), stride), blocks_of(words, stride), strict=False):
                for t, score in index.matches(block).items():
                    best[t] = max(best.get(t, 0.0), score)
                    spans.append({"label": index.labels[t], "first_word": start, "containment": score})
            starts, kept = [s for s, _ in places], {label for _, label in places}
            labels = kept | {index.labels[t] for t in best}
            rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(kept)), ",".join(sorted(labels)), 1.0 if places else max(best.values(), default=0.0), sorted(spans, key=lambda x: (x["label"], x["first_word"]))))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, base phrases and templates found, best score (1 with a base phrase, else the highest
    containment of a matched template, else 0), and every block that a template matches (label, first word, containment)."""
    made = {k: words_of(v.encode()) for k, v in (TEMPLATES if templates is None else templates).items()}
    if len(made) > MAX_TEMPLATES or any(not w or len(w) > MAX_TEMPLATE_WORDS or re.search("[,]", k) for k, w in made.items()):
        raise ValueError(f"at most {MAX_TEMPLATES} templates of 1 to {MAX_TEMPLATE_WORDS} words, with no comma in a label")
    stride = MAX_TEMPLATE_WORDS
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    vocabulary = sorted({w for s in made.values() for w in s})
    counted = texts.select("text").mapInArrow(partial(_block_frequencies, vocabulary=vocabulary, stride=stride), "word int, blocks long").groupBy("word").agg(F.sum("blocks").alias("blocks"))
    blocks = {r["word"]: r["blocks"] for r in counted.collect()}  # as many rows as the templates have words
    ranked = sorted(range(len(vocabulary)), key=lambda i: (blocks.get(i, 0), vocabulary[i]))
    order = {vocabulary[i]: rank for rank, i in enumerate(ranked)}
    return texts.mapInArrow(
        partial(_scan, templates=made, order=order, threshold=threshold, stride=stride, base=BASE_PHRASES if base is None else base),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first_word:long,containment:double>>",
    )
