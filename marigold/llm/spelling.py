"""Spelling variants: words one edit apart, grouped under their most frequent form.

The near pairs come from an even-partition pigeonhole join. A word is indexed by two segments, its first half and the rest; one edit
leaves one of them whole. Words of equal or one greater length probe with the substrings at the places where a whole segment must then
stand: the first at the start, the second shifted by the difference of lengths. Pairs that meet are candidates, verified by edit
distance; those found by both segments count once.

A segment that many words share would make them all meet. Where the words of a segment make more than LIMIT pairs, the part that the
segment leaves open is partitioned evenly once more, and so on: the words' keys then hold the segment and one half of the open part. At
the last step one code point of the indexed word (none, where lengths differ) is open, so that each pair of a key is near indeed. All
near pairs are found at every size, and no key makes more than LIMIT candidates but those that are near themselves.

Defined results: null and empty texts have no words; a null document id is an empty string in front of the colon; repeated rows count
again; ties of the form end in code-point order; a word without a near word has itself as root. The edit is one code point inserted,
deleted or replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marigold.lineage import dropped, written

#: Maximal runs of these are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Candidates that one key may make before its open part is partitioned further.
LIMIT = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): every run of letters of every text, A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("word"))


def with_slips(found: DataFrame, one_in: int) -> DataFrame:
    """(id, word): one of so many runs, by the checksum of `<id>:<run>`, loses the code point that the checksum points to."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return found.withColumn("h", h).select("id", F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(found: DataFrame, *, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    return found.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _partitioned(rows: DataFrame) -> DataFrame:
    """Both ways to leave one half of the open part of a word (of the indexed word: code points a to b) whole."""
    a, b, longer = F.col("a"), F.col("b"), F.col("longer")
    middle = a + F.floor((b - a) / 2).cast("int")
    first = F.when(b - a >= 2, middle).when(longer == 1, b).otherwise(a)  # of one open code point, a longer probe leaves none open
    second = F.when(b - a >= 2, middle).when(longer == 1, a).otherwise(b)
    halves = F.array(F.struct(first.alias("a"), b.alias("b")), F.struct(a.alias("a"), second.alias("b")))
    rows = rows.withColumn("half", F.explode(halves)).withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).drop("half")
    shift = F.when(F.col("probe"), longer).otherwise(0)
    rest = F.substring("word", F.col("b") + 1 + shift, F.char_length("word"))
    return rows.withColumn("key", F.xxhash64("size", "longer", "a", "b", F.substring("word", F.lit(1), F.col("a")), rest))


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n), once for each pair of words (word, n) one edit apart; a written table. Words are distinct."""
    size = F.char_length("word")
    roles = F.explode(F.array(*(F.struct(F.lit(p).alias("probe"), F.lit(d).alias("longer")) for p in (False, True) for d in (0, 1))))
    rows = words.select("word", "n", roles.alias("role")).select("word", "n", "role.*")
    rows = rows.withColumn("size", size - F.when(F.col("probe"), F.col("longer")).otherwise(0)).withColumns({"a": F.lit(0), "b": F.col("size")})
    found, tables = [], []
    while True:
        level = written(_partitioned(rows), "segments")
        tables.append(level)
        is_last = (F.col("b") - F.col("a") <= 1) & (F.col("longer") == 0) | (F.col("b") == F.col("a"))
        meets = level.groupBy("key").agg(F.count_if(~F.col("probe")).alias("held"), F.count_if("probe").alias("probes"), F.max(is_last).alias("last")).where("held > 0 AND probes > 0")
        meets = written(meets.select("key", ((F.col("held") * F.col("probes") > limit) & ~F.col("last")).alias("many")), "keys")
        tables.append(meets)
        few = meets.where("NOT many").select("key")
        left = level.where("NOT probe").join(few, "key").select("key", "longer", "word", "n")
        right = level.where("probe").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
        ordered = (F.col("longer") == 1) | (F.col("word") < F.col("near"))
        pairs = left.join(right, "key").where(ordered & (F.levenshtein("word", "near", 1) == 1))
        found.append(written(pairs.select("word", "n", "near", "near_n"), "pairs"))
        if meets.where("many").isEmpty():
            break
        rows = level.join(meets.where("many").select("key"), "key", "left_semi").drop("key")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    whole = written(whole.distinct(), "near")
    for t in tables + found:
        dropped(t)
    return whole


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in each round. Numbers at least double along a chain, so
    it is short."""
    held = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(held.join(onward, "root", "left"), "roots")
        if moved.where("further IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        held = moved.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, *, ratio: int = 2, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): a word's form is its most frequent near word, if that is `ratio` times as
    frequent or more; the root is the last form of the chain."""
    if ratio < 2:
        raise ValueError("a ratio of 2 at least, so that chains end")
    words = words.select("word", F.col("n").cast("long").alias("n"))
    pairs = near_pairs(words, limit)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    first: Column = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), first.alias("first"))
    formed = -F.col("first.less") >= ratio * F.col("n")
    best = written(best.select("word", "n_near", F.when(formed, F.col("first.near")).alias("form"), F.when(formed, -F.col("first.less")).alias("form_n")), "best")
    roots = _roots(best.where("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
