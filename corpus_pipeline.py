"""The corpus pipeline: five stages from raw documents to packed sequences, each by one operator of marigold.llm.

1. quality: importance resampling; documents that the draw leaves out go.
2. lines: a line found in at least 10 documents stays only where it first occurs.
3. near_duplicates: of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, one stays.
4. substrings: words covered by a repeated window of 35 words go; the white space between the others stays.
5. packing: sequences of at most 2048 tokens.

All stages but the last return the columns of documents, with n_chars kept true to the text; texts that a stage empties stay as rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigold.llm import lines, ngram_join, packing, quality, substr
from marigold.lineage import written


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    counted = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return counted.select(*(F.col(f"`{c}`") for c in columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.dedup_lines(docs, min_docs=10, min_chars=1, keep="first"), docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, shingle=5, percent=80)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substr.dedup_substrings(docs, window=35, separator="original"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("lines", dedup_lines), ("near_duplicates", keep_one_of_near_duplicates), ("substrings", dedup_substrings), ("packing", pack)]

#: SQL cannot express the draw, nor the tokenizer and the packing; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each stage returns is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
