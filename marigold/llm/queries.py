"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.lineage import written
from marigold.llm import bpe, hilbert, html_text, licenses, lines, ngram_join, ogg, packing, postings, quality, spelling, substr, vafile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.store_texts(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(encoded, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their log importance weight."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept").select("doc_id", F.round("weight", 4).alias("score"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substr.dedup_substrings(docs, window=35).select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), shingle=3, percent=90).drop("h", "root")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.exact_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by language, source and length: counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    cut = hilbert.shards(written(sized, "sizes"), ["lang", "source", "n_chars"], 40, law="rows", ties=("doc_id", "size", "text_crc32"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "hilbert.shard", "hilbert.slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.with_slips(spelling.runs(table(spark, sf_dir, "documents")), 97)
    return spelling.variants(written(spelling.counted(found, min_chars=5, min_count=3), "words"), ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


def op13_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings.build_index(table(spark, sf_dir, "documents"))
    return postings.search(index, table(spark, sf_dir, "benchmark"), k=50).select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_bpe, op3_lines, op4_quality, op5_licenses, op6_substrings, op7_ngrams, op8_topk, op9_packing, op10_html, op11_hilbert, op12_spelling, op13_postings)}
