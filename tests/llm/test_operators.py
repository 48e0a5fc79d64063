"""Every operator on a small table with all edges, against a brute-force version or an exact round trip."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import partial

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marigold.llm import bloom, bpe, html_text, licenses, lines, ngram_join, ogg, oracles, packing, pretokens, quality, queries, substr, vafile
from marigold.llm.common import buffers
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


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# 1. Ogg


def test_ogg_checksum_is_that_of_the_format():
    def bitwise(data: bytes) -> int:
        r = 0
        for byte in data:
            r ^= byte << 24
            for _ in range(8):
                r = (r << 1 ^ (0x04C11DB7 if r & 1 << 31 else 0)) & 0xFFFFFFFF
        return r

    for n in (0, 1, 5, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.page_checksum(data[: n // 2], data[n // 2 :]) == bitwise(data)


def test_ogg_round_trip_and_damage():
    payload = random.Random(3).randbytes(300_000 // 192 * 192)
    media = ogg.store(payload)
    box = ogg.read_container(media)
    audio, side = box.streams.values()
    assert b"".join(audio.packets[2:]) == payload and box.bad_pages == 0 and audio.begun and audio.ended and side.ended
    assert ogg.timestamps(audio)[-1] == len(payload) / ogg.RATE and audio.pages > 4
    times = ogg.timestamps(audio)[2:]
    assert times == [min(len(payload), (i + 1) * ogg.PACKET) / ogg.RATE for i in range(len(times))]
    broken = bytearray(media)
    broken[100_000] ^= 1
    hurt = ogg.read_container(b"junk" + bytes(broken))
    assert hurt.bad_pages == 1 and hurt.skipped_bytes >= 4
    kept = next(iter(hurt.streams.values()))
    assert 0 < len(audio.packets) - len(kept.packets) < 40 and all(p in audio.packets for p in kept.packets)
    assert ogg.read_container(None).streams == {} and ogg.read_container(media[:50]).bad_pages == 1
    exact = [b"", b"x" * 255, b"y" * 510, b"z" * 65025, b"end"]
    pages = b"".join(ogg.pages_of(5, exact, [1, 2, 3, 4, 5]))
    stream = ogg.read_container(pages).streams[5]
    assert stream.packets == exact and stream.granules[-1] == 5


def test_ogg_query(docs, rows, empty):
    got = ogg.media_features(ogg.store_texts(docs)).collect()
    assert len(got) == len(rows) and ogg.media_features(ogg.store_texts(empty)).count() == 0
    have = Counter()
    for r in rows:
        data = (r.text or "").encode()
        data += b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        have[r.doc_id, len((r.text or "").encode()), len(data), sha(data), zlib.crc32(data[-16:])] += 1
    assert have == Counter((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in got)
    by_payload = defaultdict(set)
    for g in got:
        by_payload[g.payload_sha256].add((g.media_sha256, g.media_bytes, g.feature))
    assert all(len(x) == 1 for x in by_payload.values())
    packets = ogg.packets(ogg.store_texts(docs).where("doc_id = 6"), id_col="doc_id", media_col="media")
    assert packets.select("serial").distinct().count() == 2 and packets.where("seconds > 0").count() > 10


def test_ogg_files_of_another_writer():
    """Pages cut anywhere, three interleaved streams and a lost page, by a writer of its own."""
    rnd = random.Random(12)

    def crc(data: bytes) -> int:
        r = 0
        for byte in data:
            r ^= byte << 24
            for _ in range(8):
                r = (r << 1 ^ (0x04C11DB7 if r & 1 << 31 else 0)) & 0xFFFFFFFF
        return r

    def page(serial: int, number: int, flags: int, granule: int, lacing: list[int], body: bytes) -> bytes:
        head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
        rest = bytes([len(lacing), *lacing]) + body
        return head + crc(head + bytes(4) + rest).to_bytes(4, "little") + rest

    for _ in range(12):
        packets, made, spans = {}, {}, {}
        for serial in (3, 77, 2**32 - 1):
            packets[serial] = [rnd.randbytes(rnd.choice([0, 1, 254, 255, 256, 510, rnd.randrange(900)])) for _ in range(rnd.randint(1, 12))]
            units = []  # (lacing value, piece, packet, last of its packet)
            for i, packet in enumerate(packets[serial]):
                cut = [packet[j : j + 255] for j in range(0, len(packet), 255)] + ([b""] if len(packet) % 255 == 0 else [])
                units += [(len(c), c, i, j == len(cut) - 1) for j, c in enumerate(cut)]
            made[serial], spans[serial], at, number = [], [set() for _ in packets[serial]], 0, 0
            while at < len(units):
                some = units[at : at + rnd.randint(1, 6)]
                done = [i for _, _, i, last in some if last]
                flags = (1 if at and not units[at - 1][3] else 0) | (2 if not at else 0) | (4 if at + len(some) == len(units) else 0)
                made[serial].append(page(serial, number, flags, 100 * (done[-1] + 1) if done else -1, [u[0] for u in some], b"".join(u[1] for u in some)))
                for _, _, i, _ in some:
                    spans[serial][i].add(number)
                at, number = at + len(some), number + 1
        queues, media = {k: list(v) for k, v in made.items()}, []
        while any(queues.values()):
            media.append(queues[rnd.choice([k for k, v in queues.items() if v])].pop(0))
        box = ogg.read_container(b"".join(media))
        assert {k: v.packets for k, v in box.streams.items()} == packets and box.bad_pages == box.skipped_bytes == 0
        for serial, stream in box.streams.items():
            assert stream.begun and stream.ended and stream.pages == len(made[serial]) and stream.granules[-1] == 100 * len(packets[serial])
            assert all(g is None or g == 100 * (i + 1) for i, g in enumerate(stream.granules))
        serial = rnd.choice([k for k, v in made.items() if len(v) > 1] or [3])
        gone = rnd.randrange(len(made[serial]))
        left = ogg.read_container(b"".join(m for m in media if m != made[serial][gone])).streams
        assert (left[serial].packets if serial in left else []) == [p for p, s in zip(packets[serial], spans[serial], strict=True) if gone not in s]


# 2. BPE


@pytest.mark.parametrize("pattern,spans", [(public_tokenizers.PATTERN, "spaced"), (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "bare")])
def test_pretokens_equal_the_pattern(pattern, spans):
    compiled, rnd, alphabet = regex.compile(pattern), random.Random(1), list("  \n\t\x1c\x85'''sstrevmlld12.,éß\xa0 　x-漢") + ["'ll", "'re", "😀"]
    for _ in range(1500):
        some = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 5))]
        data, offsets = buffers(pa.array(some, pa.string()))
        points, at, edges = pretokens.code_points(data, offsets)
        if spans == "spaced":
            starts = pretokens.spaced_starts(points, edges)
            ends = np.append(starts[1:], len(points)) if len(starts) else starts
        else:
            starts, ends = pretokens.bare_spans(points, edges)
        got = [data[at[a] : at[b]].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        assert got == [w for t in some for w in compiled.findall(t)], some


def test_bpe_equals_the_library(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoded = bpe.encode(docs, path, chunk_bytes=20_000)
    got = bpe.decode(encoded.withColumn("copy", F.col("ids")), path).collect()
    want = Counter((r.doc_id, np.array(encoding.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in rows)
    assert want == Counter((g.doc_id, bytes(g.copy), bytes(g.decoded)) for g in got) and all(g.n_tokens * 4 == len(g.copy) for g in got)
    assert bpe.encode(empty, path).count() == 0


# 3. Lines


def test_bloom_has_no_false_negatives(spark):
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**63, 60_000).astype(np.uint64)
    twice = h[:9000]
    df = spark.createDataFrame(pa.table({"h": pa.array(np.concatenate([h, twice]).view(np.int64))}).to_pandas()).repartition(5)
    test = bloom.twice_seen(df, lambda batches: (np.asarray(b.column(0)).view(np.uint64) for b in batches), 69_000)
    assert test(twice).all() and test(h[9000:]).mean() < 0.01


@pytest.mark.parametrize("min_docs", [2, 10, 15])
def test_lines_none_kept(docs, rows, min_docs):
    bad = T.dropped_lines([r.text for r in rows], min_docs)
    got = lines.dedup_lines(docs, min_docs=min_docs)
    assert got.columns == [*docs.columns, "line_dedup"]
    want = Counter()
    for r in rows:
        own, keys = (r.text or "").split("\n"), T.line_keys(r.text)
        want[r.doc_id, r.lang, len(own), sum(k in bad for k in keys), "\n".join(x for x, k in zip(own, keys, strict=True) if k not in bad)] += 1
    assert want == Counter((g.doc_id, g.lang, g.line_dedup.n_lines, g.line_dedup.n_dropped, g.text) for g in got.collect())


def test_lines_first_kept(spark, empty):
    data = [(3, "B\nonly"), (1, "a\nb"), (2, " A \nb\na"), (4, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, min_docs=2, keep="first").collect()}
    assert got == {1: "a\nb", 2: "", 3: "only", 4: ""}
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, min_docs=1, keep="first").collect()}
    assert got == {1: "a\nb", 2: "", 3: "only", 4: ""}
    assert lines.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(df, keep="last")


# 4. Quality


def test_quality_separates_and_draws_k(spark):
    rnd = random.Random(2)
    good, junk = [f"word{i}" for i in range(200)], [f"%junk{i}%" for i in range(40)]
    data = [(i, " ".join(rnd.choices(junk if i % 5 == 0 else good, k=120)), i % 5 != 0) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, good boolean").repartition(4)
    labels = df.where("doc_id % 2 = 0").select("doc_id", F.col("good").cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.classify(df, labels).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept) == 320 and sum(i % 5 != 0 for i in kept) >= 317
    assert {r.doc_id for r in sorted(got, key=lambda r: -r.key)[:320]} == kept
    assert {r.doc_id for r in quality.classify(df, labels).where("kept").collect()} == kept  # the draw repeats
    assert {r.doc_id for r in quality.keep_drawn(df, labels).collect()} == kept
    held_out = [r for r in got if r.doc_id % 2]
    assert min(r.weight for r in held_out if r.doc_id % 5) > max(r.weight for r in held_out if r.doc_id % 5 == 0)


def test_quality_edges(docs, rows, empty, spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, None), (None, 1, 0), (5, None, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert quality.classify(empty, labels).count() == 0 and quality.classify(docs, labels.where("doc_id = -1")).where("kept").count() == len(rows)
    assert quality.keep_drawn(docs, labels).columns == docs.columns


def test_quality_counts_every_gram_by_itself(spark, monkeypatch):
    rnd = random.Random(6)  # over two million distinct bigrams: a rare bad word keeps its own counter
    data = [(i, " ".join([f"w{rnd.randrange(3000)}" for _ in range(1000)] + ["vile"] * (i % 50 == 0))) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    labels = df.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 50 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(quality, "GROUP", 1 << 18)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 1 << 20)
    near = {r.doc_id: r.weight for r in quality.classify(df, labels).collect()}  # some grams share a bucket
    monkeypatch.setattr(quality, "BUCKETS", 1 << 20)
    got = quality.classify(df, labels).collect()
    assert 0 < max(abs(near[r.doc_id] - r.weight) for r in got) < 0.2
    raw, good = Counter(), Counter()
    for i, text in data:
        words = text.split()
        grams = [("w", w) for w in words] + [("b", *b) for b in zip(words, words[1:], strict=False)] + [("h", w[:4]) for w in words if len(w) > 5]
        raw.update(grams)
        if i % 50:
            good.update(grams)
    size, total = sum(good.values()), sum(raw.values())

    def ratios(i: int, text: str) -> tuple[list, dict]:
        """A document's grams by family, and their log ratios in models without it."""
        words = text.split()
        families = [[("w", w) for w in words], [("b", *b) for b in zip(words, words[1:], strict=False)], [("h", w[:4]) for w in words if len(w) > 5]]
        own = Counter(g for f in families for g in f)
        return families, {g: np.log((good[g] - n * bool(i % 50) + quality.PRIOR) / ((raw[g] - n) * size / total + quality.PRIOR)) for g, n in own.items()}

    mean = sum(sum(log[g] for f in families for g in f) for families, log in (ratios(i, t) for i, t in data if i % 50)) / size
    weights = {r.doc_id: r.weight for r in got}
    for i, text in data[::25]:
        (one, two, heads), log = ratios(i, text)
        n = len(one) + len(two)
        want = quality.WEIGHT_GRAMS * (sum(log[g] for g in one + two) - mean * n) / (n + quality.SHRINK) + sum(log[g] for g in one + heads if log[g] < quality.TAIL)
        assert weights[i] == pytest.approx(want, abs=1e-5)


def test_quality_noise(spark):
    """Keys are weight / temperature plus standard Gumbel noise of seed, id and text; a high temperature leaves the draw to the noise."""
    df = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad junk there ") * 40 + f"row{i}") for i in range(2000)], "doc_id long, text string")
    labels = df.where("doc_id < 500").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))

    def mixed(x: int) -> int:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2**64
        return x ^ x >> 31

    for seed, temperature in ((1, 1.0), (9, 1e6)):
        got, noise = quality.classify(df, labels, seed=seed, temperature=temperature).collect(), []
        for r in got:
            u = ((mixed((mixed((r.h + seed) % 2**64) + r.doc_id) % 2**64) >> 11) + 0.5) / 2**53
            noise.append(-math.log(-math.log(u)))
            assert r.key == pytest.approx(r.weight / temperature + noise[-1], abs=1e-9)
        assert abs(np.mean(noise) - 0.5772) < 0.1 and abs(np.var(noise) - math.pi**2 / 6) < 0.2
        share = sum(r.doc_id % 2 for r in got if r.kept) / 1000
        assert sum(r.kept for r in got) == 1000 and (share > 0.99 if temperature == 1 else 0.4 < share < 0.6)


def test_quality_on_held_out_labels(spark):
    """The operator itself, with half of the labels held out: good ones stay; bad ones, unlike in the models' counts, do not."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_drawn(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0")).select("doc_id").collect()}
    held_out = labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()
    share = lambda rows: sum(r.doc_id in kept for r in rows) / len(rows)
    assert share([r for r in held_out if r.quality == 1 and not r.toxic]) > 0.93
    assert share([r for r in held_out if r.quality == 0]) < 0.06


def test_kth_largest(spark):
    rnd = random.Random(5)
    values = [rnd.choice([1.5, 2.5, rnd.gauss(0, 1e6), rnd.random()]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 4500, 8999, 9000):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


# 5. Licences


def test_licenses_against_brute_force(docs, rows, empty):
    made = {k: set(licenses.words_of(v.encode())) for k, v in licenses.TEMPLATES.items()}
    got = {}
    for g in licenses.scan_licenses(docs).collect():
        got.setdefault((g.doc_id, g.n_words), []).append(g)
    for r in rows:
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(T.LOWER))
        places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if " ".join(w[i : i + len(p.split())]) == p]
        found = {k: max(len(s & set(b)) / len(s) for b in ([w[i : i + 256] for i in range(0, max(1, len(w) - 128), 128)])) for k, s in made.items()}
        found = {k: v for k, v in found.items() if v >= 0.8}
        g = got[r.doc_id, len(w)][0]
        assert g.n_base == len(places) and g.base_labels == ",".join(sorted({x for _, x in places})) and g.labels == ",".join(sorted({x for _, x in places} | set(found)))
        assert (g.first_word, g.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert g.score == pytest.approx(1.0 if places else max(found.values(), default=0.0))
    assert licenses.scan_licenses(empty).count() == 0


def test_set_join_filters_lose_nothing():
    rnd = random.Random(4)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    order = {w: i for i, w in enumerate(vocabulary)}
    templates = {f"t{i}": rnd.sample(vocabulary, rnd.randint(1, 20)) for i in range(40)}
    for threshold in (0.5, 0.8, 1.0):
        index = licenses.TemplateIndex(templates, order, threshold)
        for _ in range(200):
            block = rnd.choices([*vocabulary, b"other"], k=rnd.randint(0, 90))
            want = {i for i, x in enumerate(index.labels) if len(set(templates[x]) & set(block)) >= threshold * len(set(templates[x])) - 1e-9}
            assert set(index.matches(block)) == want


# 6. Substrings


@pytest.mark.parametrize("window", [35, 5, 2])
def test_substrings_against_brute_force(docs, rows, window):
    kept = T.uncovered([r.text for r in rows], window)
    want = Counter((r.doc_id, r.source, len(T.words(r.text)), len(T.words(r.text)) - len(k), " ".join(k)) for r, k in zip(rows, kept, strict=True))
    got = substr.dedup_substrings(docs, window=window)
    assert got.columns == [*docs.columns, "substring_dedup"]
    assert want == Counter((g.doc_id, g.source, g.substring_dedup.n_words, g.substring_dedup.n_removed, g.text) for g in got.collect())


def test_substrings_keep_white_space(docs, rows, empty):
    kept = T.uncovered([r.text for r in rows], 35)
    got = substr.dedup_substrings(docs, window=35, separator="original").collect()
    assert Counter((r.doc_id, tuple(k)) for r, k in zip(rows, kept, strict=True)) == Counter((g.doc_id, tuple(T.words(g.text))) for g in got)
    assert next(g.text for g in got if g.doc_id == 7) == "a\n\nb\n a \nA"
    assert substr.dedup_substrings(empty).count() == 0


def test_suffix_tree_leaves():
    rnd = random.Random(7)
    for _ in range(50):
        paths = [tuple(rnd.randint(0, 1) for _ in range(4)) for _ in range(rnd.randint(0, 12))]
        several = np.array([rnd.random() < 0.1 for _ in paths], bool)
        columns = [np.array([p[j] for p in paths], np.uint64) for j in range(4)]
        counts = Counter(paths)
        assert substr.repeated_leaves(columns, several).tolist() == [bool(counts[p] > 1 or s) for p, s in zip(paths, several, strict=True)]


# 7. N-gram join


@pytest.mark.parametrize("shingle,percent,block,longest", [(3, 90, 512, 32), (5, 80, 3, 2), (2, 60, 2, 4), (3, 90, 512, 1)])
def test_ngram_join_against_brute_force(docs, rows, monkeypatch, shingle, percent, block, longest):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LIST", longest)
    roots = T.components([r.text for r in rows], shingle, percent)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    sets = [frozenset(T.shingles(r.text, shingle)) for r in rows]
    links = {s: sum(100 * len(s & t) >= percent * len(s | t) for t in set(sets) if t and t != s) if s else 0 for s in set(sets)}
    want = Counter((r.doc_id, len(s), least.get(c) if s else r.doc_id, links[s]) for r, c, s in zip(rows, roots, sets, strict=True))
    got = ngram_join.linked_components(docs, shingle=shingle, percent=percent).collect()
    assert want == Counter((g.doc_id, g.n_shingles, g.component_id, g.n_links) for g in got)
    whole = defaultdict(set)
    for g in got:
        whole[g.root].add(g.component_id)
    assert all(len(ids) == 1 for root, ids in whole.items() if root is not None)


def test_links_between_blocks():
    rnd = random.Random(5)
    for percent in (50, 80, 90):
        sets = [np.array(sorted({rnd.randrange(30 if i % 2 else 60) for _ in range(rnd.randint(1, 40))}), np.uint64) for i in range(40)]
        sets += [np.append(sets[0], np.uint64(100 + i)) for i in range(5)]
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        every, half = np.arange(len(sets)), len(sets) // 2
        got = ngram_join.links_between(sets, every, None, percent).tolist()
        assert len(got) == len(want) and {(max(p), min(p)) for p in got} == want
        got = ngram_join.links_between(sets, every[:half], every[half:], percent).tolist()
        assert sorted(map(sorted, got)) == sorted([j, i] for i, j in want if j < half <= i)


def test_links_within_one_group(spark):
    """Sets of one size and prefix that share the prefix with no other group: they differ only in shingles that other texts hold often."""
    n, percent = 40, 90
    prefix, rest = np.arange(5, dtype=np.uint64), np.arange(100, 100 + n - 5, dtype=np.uint64)
    sets = [np.concatenate([prefix, rest]), np.concatenate([prefix, rest[:-1], np.array([500], np.uint64)])]
    assert ngram_join.links_between(sets, np.arange(2), None, percent).tolist() == [[0, 1]]
    ends = ["p q r s", "p q t u"]
    copies = [" ".join(f"a{i}" for i in range(60)) + " " + end for end in ends]
    mixed = [f"a58 a59 {' '.join(end.split()[:k])} m{i}" for i in range(9) for end in ends for k in (2, 3, 4)]
    frequent = [f"a59 {end} z{i}" for i in range(9) for end in ends]
    texts = [*copies, *mixed, *frequent]
    got = ngram_join.linked_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {g.doc_id: g.component_id for g in got} == {i: c for i, c in enumerate(T.components(texts, 3, 90))}
    assert [g.component_id for g in sorted(got, key=lambda g: g.doc_id)][:2] == [0, 0]


def test_keep_one(spark, docs, rows, empty):
    """As multisets: rows without words all stay, and one row of each component, which ties do not leave to chance."""
    roots, want = T.components([r.text for r in rows], 5, 80), Counter()
    groups = defaultdict(list)
    for r, c in zip(rows, roots, strict=True):
        groups[c if T.words(r.text) else -1].append(r)
    want.update((r.doc_id, r.text) for r in groups.pop(-1))
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        want.update([(r.doc_id, r.text) for r in g] if not ids else [next((r.doc_id, r.text) for r in g if r.doc_id == min(ids))])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert ngram_join.keep_one(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c", "z"), (1, "a b c", "y"), (1, "A B c", "x"), (2, "", "w"), (2, "", "w"), (2, " ", "v"), (None, "p q", "u"), (None, "p q", "u"), (1, "k", "t")], "doc_id long, text string, `a.b` string")
    least = min(("a b c", "A B c"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    want = Counter([(1, least, "y" if least == "a b c" else "x"), (2, "", "w"), (2, "", "w"), (2, " ", "v"), (None, "p q", "u"), (None, "p q", "u"), (1, "k", "t")])
    assert Counter(tuple(r) for r in ngram_join.keep_one(same).collect()) == want


# 8. Top-k


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vafile, "CANDIDATE_BLOCK", 70)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 5)
    rnd = np.random.default_rng(3)
    data = [(i, [float(x) for x in rnd.normal(size=16).round(1)]) for i in range(400)] + [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, []), (405, [1.0] * 9), (None, [1.0] * 16)]
    data += [(500 + i, data[0][1]) for i in range(20)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vafile.exact_topk(df, df.where("vec_id % 10 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = {i: np.array([np.floor(256 * x) for x in v] + [0.0] * (16 - len(v))) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {q: [(n + 1, i, s) for n, (s, i) in enumerate((-a, b) for a, b in sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:5])] for q in fine if q % 10 == 0}
    assert got == want
    few = df.where("vec_id < 3")
    assert vafile.exact_topk(few, few, k=5).count() == 6 and vafile.exact_topk(df.where("vec_id < 0"), df, k=5).count() == 0


def test_topk_of_large_components_equals_sql(spark, tmp_path):
    rnd = np.random.default_rng(4)
    data = [(i, [float(x) for x in rnd.normal(size=8) * 10.0 ** rnd.integers(0, 6)]) for i in range(200)]
    data += [(200, [20000.0] * 8), (201, [20000.5] * 8), (202, [20000.5] * 8), (203, [5e6, -5e6, 1 / 256, 0.3, 0.0, 0.0, 0.0, 0.0]), (204, [5e6, -5e6, 2 / 256, 0.3, 0.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op8_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(oracles.OP8).fetchall())


@pytest.mark.parametrize("power", [0, 40, 900])
def test_exact_scores_and_bounds(power):
    rnd = np.random.default_rng(5)
    x = np.ldexp(np.floor(rnd.normal(size=(60, 5)) * 2.0**44) / 256, power)
    x[30:40], x[40:50] = x[0], x[1] + np.ldexp(1.0, power - 8)
    q = np.roll(x, 7, axis=0)
    whole = lambda a: [[(n << 8) // d for n, d in map(float.as_integer_ratio, row)] for row in a.tolist()]
    want = [sum(u * v for u, v in zip(a, b, strict=True)) for a, b in zip(whole(q), whole(x), strict=True)]
    assert vafile.exact_scores(q, x) == want
    small = np.ldexp(x, -power - 60)
    middle, error = vafile.bounds(np.roll(small, 7, axis=0), *vafile.cells(small))
    exact = np.roll(small, 7, axis=0) @ small.T
    assert (np.abs(middle - exact) <= error).all() and (error > 0).all()


def test_topk_ids(spark):
    """Repeated ids, repeated rows, one vector that a third of all rows share, and a dotted column name."""
    rnd = random.Random(8)
    data = [(i // 2, [float(rnd.randrange(-3, 4)) for _ in range(4)]) for i in range(120)] + [(200 + i % 25, [3.0] * 4) for i in range(60)] + [(7, [3.0] * 4)] * 9
    df = spark.createDataFrame(data, "id long, `v.x` array<double>")
    queries_, want = {(i, tuple(v)) for i, v in data if i % 7 == 0}, Counter()
    for i, v in queries_:
        best = sorted((-int(65536 * np.dot(v, w)), j) for j, w in data if j != i)[:5]
        want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    got = vafile.exact_topk(df, df.where("id % 7 = 0"), k=5, id_col="id", vector_col="v.x")
    assert Counter(map(tuple, got.collect())) == want


def test_topk_score_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [2.0**60]), (1, [2.0**60]), (2, [-(2.0**60)])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        vafile.exact_topk(df, df.where("vec_id = 0"), k=1).collect()


# 9. Packing


def test_packing_round_trip(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id, len(ids)] += len(ids)
    have = Counter()
    for p in pieces:
        have[p.doc_id, p.doc_tokens] += p.length
    assert have == want and packing.pack(empty, path).count() == 0
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = [p for p in pieces if p.doc_id == r.doc_id and p.doc_tokens == len(ids)]
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)


def test_tokenizer_words_equal_the_library():
    cache, rnd = packing.WordCache(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()), random.Random(8)
    alphabet = list(" \n'aAbBsStTdDéÉßİΣς12٣.,-!漢") + ["'ll", "don't", "é", "<|endoftext|>", "the ", "😀"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(400)]
    for t, ids in zip(texts, cache.encode(texts), strict=True):
        assert ids.tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_least_squares():
    rnd = np.random.default_rng(6)
    for _ in range(20):
        a, b = rnd.random((12, 20)), rnd.normal(size=12)
        x = packing.nonnegative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and abs(gradient[x > 1e-9]).max(initial=0) < 1e-6
    c = packing.combinations(12, 3)
    assert c.shape[1] == 1 + 6 + 12 and (np.arange(1, 13) @ c == 12).all()
    histogram = rnd.integers(0, 500, packing.BINS)
    used, counts = packing.plan(histogram)
    assert ((used @ counts) <= histogram).all() and (used @ counts).sum() > 0.8 * histogram.sum()


# 10. HTML


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two <br>three<div>four<span hidden>no</span></div>", "one\n\ntwo\nthree\n\nfour"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y<p>z</ol>", "- a\n- b\n  - c\n\n3. x\n4. y\n\n   z"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>z<td>4 <b>5</b></table>", "Name       Qty\napple pie  3\nz          4 5"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide wide</table>", "a  b\n   c\nwide wide"),
        ("<pre>\n a  b\n  c</pre>d", " a  b\n  c\n\nd"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><title>t</title>x<!-- c -->y", "xy"),
        ("<p style='visibility:hidden'>a<b style='visibility:visible'>b</b></p><p style='display : none'>c</p>", "b"),
        ("<details><summary>s</summary>hidden</details><dialog>no</dialog><input type=hidden value=q><input type=submit value=Go>", "s\nGo"),
        ("</div></p>x<b>y</i>z", "x" + "yz"),
        ("<a href='x>y'>link</a> 1 < 2", "link 1 < 2"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<h1>t</h1><blockquote>q</blockquote><dl><dt>a<dd>b</dl><hr>", "t\n\n  q\n\na\n  b\n\n---"),
        ("<table>stray<tr><td>x</table>", "stray\n\nx"),
    ],
)
def test_html(page, text):
    assert html_text.html_to_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><form><tr><td>x</td></tr></form></table>", "x"),
        ("<table><b>x</b><tr><td>y</table>", "x\n\ny"),
        ("<table><div>x</div><tr><td>y</table>z", "x\n\ny\n\nz"),
        ("<table><tr><td>a</td><b>x</b></tr><tr><td>c</table>", "x\n\na\nc"),
        ("<table><tr><b>x<td>a<td>c</table>", "x\n\na  c"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
        ("<table><tr><table><tr><td>x</table></table>", "x"),
        ("<table><tbody><p>x<br>y</p><tr><td>a</table>", "x\ny\n\na"),
        ("<table><tr><td>a<table><tr><td>in</table><tr><td>b</table>", "a\n\nin\nb"),
        ("<table><script>no</script><style>no</style><input type=submit value=Go><caption>c</caption><tr><td>a</table>", "Go\n\nc\na"),
    ],
)
def test_html_text_beside_cells(page, text):
    assert html_text.html_to_text(page) == text


@pytest.mark.parametrize("deep", ["<font>" * 300, "<div>" * 300, "<span><a>" * 5000])
@pytest.mark.parametrize(
    "page,text",
    [
        ("<script>no</script><style>no</style>x", "x"),
        ("a<b style='display:none'>no<b>no</b>no</b>c<p hidden>no</p>", "ac"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "- a\n- b\n\nc  d"),
        ("<div hidden>no<div>no</div>no</div>x", "x"),
    ],
)
def test_html_depth_has_no_limit(deep, page, text):
    assert html_text.html_to_text(deep + page) == text


def test_html_depth_of_blocks_and_long_spans():
    assert html_text.html_to_text("<blockquote>" * 2000 + "x") == "  " * 2000 + "x"
    assert html_text.html_to_text("<table><tr><td>" * 1000 + "x") == "x"
    rows = html_text.html_to_text("<table><tr><td rowspan=300>a<td>b" + "<tr><td>c" * 299 + "<tr><td>d</table>").split("\n")
    assert rows == ["a  b"] + ["   c"] * 299 + ["d"]


def test_html_table_of_pages(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", 5), (2, None, 6), (None, "b" * 100_000, 7)], "page_id long, html string, text int")
    assert [(r.page_id, r.n_lines) for r in html_text.extract_text(df).orderBy("page_id").collect()] == [(None, 1), (1, 1), (2, 0)]
    assert html_text.extract_text(df.where("page_id = 9")).count() == 0


def test_html_tokens_against_a_regular_expression():
    """The tokenizer against one that backtracks, on random markup."""
    tag = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</?((?>[a-zA-Z][^\s/>]*))((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)

    def plain(html: str) -> list[tuple[str, str, str]]:
        out, at = [], 0
        while at < len(html):
            m = tag.search(html, at)
            if m is None:
                return [*out, ("text", html[at:], "")]
            out += [("text", html[at : m.start()], "")] if m.start() > at else []
            at = m.end()
            if m[1] and m[0][1] == "/":
                out.append(("end", m[1].lower(), ""))
            elif m[1]:
                out.append(("start", m[1].lower(), m[2]))
                if m[1].lower() in html_text.RAW and not m[2].endswith("/"):
                    close = re.compile(rf"</{m[1]}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                    out += [("raw", html[at : close.start()], ""), ("end", m[1].lower(), "")]
                    at = close.end()
        return out

    rnd, parts = random.Random(4), ["<", ">", "</", "<a", "<A b", "<!--", "-->", "--!>", "<!", "<?", "'", '"', "=", " ", "\n", "x", "/", "<script>", "</script", "</ScRiPt >", "<p>", "</p>", "&lt;", "-", "é"]
    for _ in range(20_000):
        page = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert list(html_text.tokens(page)) == plain(page), page


def lines_of_plain_blocks(tree: list) -> list[str]:
    """Visible text by block of a made-up tree: (name, attributes, children) or text; a brute-force version for simple pages."""
    out, line = [], []

    def flush():
        text = re.sub(r"[ \t\n\f\r]+", " ", "".join(line)).strip(" ")
        out.extend([text] if text else [])
        line.clear()

    def walk(node):
        if isinstance(node, str):
            line.append(node)
        elif node[0] not in ("script", "style", "template") and "hidden" not in node[1]:
            block = node[0] in ("div", "section", "p", "article")
            for step in ([flush] if block else []) + [partial(walk, c) for c in node[2]] + ([flush] if block or node[0] == "br" else []):
                step()

    for n in tree:
        walk(n)
    flush()
    return out


def test_html_against_brute_force():
    rnd = random.Random(11)

    def made(depth: int, inline: bool) -> list:
        out = []
        for _ in range(rnd.randint(0, 4)):
            kind = rnd.choice(["text", "text", "b", "span", "br", "script"] + ([] if inline else ["div", "section", "article", "p"]))
            if kind == "text" or depth > 4:
                out.append(" ".join(rnd.choices(["red", "blue", "a", "the"], k=rnd.randint(1, 4))) + rnd.choice(["", " ", "\n  "]))
            else:
                children = [] if kind == "br" else ["if (a < b) {}"] if kind == "script" else made(depth + 1, inline or kind in ("b", "span", "p"))
                out.append((kind, rnd.choice(["", "", "", " hidden", " class='x>y'"]) if kind != "br" else "", children))
        return out

    def written(node) -> str:
        if isinstance(node, str):
            return node
        return f"<{node[0]}{node[1]}>" + ("" if node[0] == "br" else "".join(map(written, node[2])) + f"</{node[0]}>")

    for _ in range(500):
        tree = made(0, False)
        assert [x for x in html_text.html_to_text("".join(map(written, tree))).split("\n") if x.strip()] == lines_of_plain_blocks(tree), tree


@pytest.mark.parametrize("unit", ["<a ", "<a '", "<a", "<a \"'", "<script>", "</script ", "<!-", "<a '>\"", "<b>", "<table><tr>", "<p>", "</p>", "&amp", "<li>"])
def test_html_is_linear_in_hostile_pages(unit):
    page = unit * ((1 << 20) // len(unit))
    began = time.perf_counter()
    if unit in ("<b>", "<table><tr>", "<p>", "</p>", "<li>"):
        page = page[: 1 << 17]
    html_text.html_to_text(page)
    html_text.html_to_text("<script>" + page)
    assert time.perf_counter() - began < 8


def test_licences_are_linear_in_hostile_texts(spark):
    began = time.perf_counter()
    assert len(licenses._phrase_starts(b"cc by".split() * 170_000, [(b" cc by ", "cc-by")])) == 170_000
    assert time.perf_counter() - began < 2
    text = " ".join([licenses.TEMPLATES["mit-notice"], *(["filler"] * 600), licenses.TEMPLATES["mit-notice"]])
    found = licenses.scan_licenses(spark.createDataFrame([(1, text)], "`a.b` long, `t.t` string"), id_col="a.b", text_col="t.t").first()
    assert len({b.first_word for b in found.blocks}) >= 2 and {b.label for b in found.blocks} == {"mit-notice"} and found.score == 1.0
