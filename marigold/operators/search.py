"""Keyword and vector search.

A query vector is a literal of the plan, so scoring needs no join; scores are projected, then ordered with a limit, which Spark runs
as a top-k per task and one merge. A set of query vectors meets the corpus in blocks (vector_blocks)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marigold.functions import hashing, text, vectors
from marigold.operators import stats, vector_blocks

MAX_QUERIES = 10_000
#: Rows and queries of a block of vectors; values of a matrix of query words by queries.
ROW_BLOCK, QUERY_BLOCK, MATRIX = 8192, 2048, 1 << 24


def literal_vector(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def cosine_topk(df: DataFrame, query: Sequence[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = 6) -> DataFrame:
    """The k rows of highest cosine, ties to the smaller id; adds `score`. Null vectors take no part."""
    score = vectors.cosine(F.col(vector_col), literal_vector(query))
    score = F.round(score, digits) if digits is not None else score
    return df.where(F.col(vector_col).isNotNull()).withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


def inner_product_topk(df: DataFrame, query: Sequence[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """The flat index: inner product of unit vectors."""
    score = F.round(vectors.dot(vectors.unit(F.col(vector_col)), vectors.unit(literal_vector(query))), digits)
    return df.where(F.col(vector_col).isNotNull()).withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


def _scored(c: DataFrame, q: DataFrame, id_col: str, vector_col: str, digits: int) -> DataFrame:
    """(query_id, id, score): each row with each query, whatever their vectors are."""
    n = q.limit(MAX_QUERIES + 1).count()
    q = q.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"), vectors.norm(F.col(vector_col)).alias("_qn"))
    c = c.select(id_col, vector_col, vectors.norm(F.col(vector_col)).alias("_n"))
    if n <= MAX_QUERIES:
        pairs = c.join(F.broadcast(q), F.col(id_col) != F.col("query_id"))
    else:  # every block of queries meets every block of rows, each pair of blocks by a key of its own
        blocks = {"_b": -(-q.count() // MAX_QUERIES), "_r": max(1, -(-c.count() // ROW_BLOCK))}
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[n] - 1).cast("long")))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(blocks[n]))
        rows, asked = c.withColumn("_r", dealt(id_col, "_r")).withColumn("_b", every("_b")), q.withColumn("_b", dealt("query_id", "_b")).withColumn("_r", every("_r"))
        pairs = rows.join(asked, ["_b", "_r"]).where(F.col(id_col) != F.col("query_id"))
    score = F.round(vectors.dot(F.col(vector_col), F.col("_q")) / (F.col("_n") * F.col("_qn") + vectors.EPSILON), digits)
    return pairs.select("query_id", id_col, score.alias("score"))


def similar(df: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score): the k nearest by cosine of each query row, itself excluded before ranking.

    Vectors of the most frequent length meet in blocks; those of another length or with values that are no numbers meet row by row."""
    c, q = (d.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vector_col) for d in (df, queries))
    mode = stats.dimension_mode(c, vector_col).first()
    dimension = int(mode["dimension"]) if mode is not None else 0
    fine = vector_blocks.fine(F.col(vector_col), dimension) if dimension > 0 else F.lit(False)
    count = lambda d: d.agg(F.count(F.when(fine, 1)).alias("fine"), F.count(F.when(~fine, 1)).alias("odd")).first()
    rows, asked = count(c), count(q)
    parts = []
    if rows.fine and asked.fine and k > 0:
        block = lambda d, name, n: vector_blocks.packed(d.where(fine), dimension, name, id_col=id_col, vector_col=vector_col, rows=n)
        dealt = q.repartition(-(-asked.fine // QUERY_BLOCK), id_col)
        parts.append(vector_blocks.nearest(block(c, "rows", ROW_BLOCK), block(dealt, "asked", QUERY_BLOCK), k, digits, dimension).withColumnRenamed("id", id_col))
    if rows.odd or not parts:
        parts.append(_scored(c.where(~fine), q, id_col, vector_col, digits))
    if asked.odd:
        parts.append(_scored(c.where(fine), q.where(~fine), id_col, vector_col, digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def infer_label(df: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(query_id, label, weight): the label of most weight among k neighbours, weight max(0, score), ties to the smaller label."""
    near = similar(df, queries, k, id_col=id_col, vector_col=vector_col).join(df.select(id_col, label_col), id_col).where(F.col(label_col).isNotNull())
    votes = near.groupBy("query_id", label_col).agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("score"))), 6).alias("weight"))
    best = Window.partitionBy("query_id").orderBy(F.desc("weight"), label_col)
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("query_id", label_col, "weight")


def hash_embedding_buckets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 64, kind: str = "sha256") -> DataFrame:
    """(id, bucket, weight): the non-zero components of the L2-normalised hash embedding.

    kind: "sha256" over white-space tokens, or "fnv1a" over [a-z0-9]+; the two spaces never mix. Rows are embedded one by one."""
    whole = hash_embeddings(df, id_col=id_col, text_col=text_col, dimensions=dimensions, kind=kind)
    return whole.select(id_col, F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0")


def hash_embeddings(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 64, kind: str = "sha256") -> DataFrame:
    """(id, vector): dense hash embeddings, without a shuffle; a text without tokens has the zero vector."""
    words = text.tokens(F.col(text_col)) if kind == "sha256" else text.ascii_words(F.col(text_col))
    return df.select(id_col, hashing.hashed_vectors(words, kind, dimensions).alias("vector"))


def text_neighbours(df: DataFrame, query_id: int, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the k texts closest to one text of the table by FNV-1a hash embedding; texts without words take no part."""
    embedded = lambda rows: hash_embeddings(rows, id_col=id_col, text_col=text_col, kind="fnv1a")
    found = embedded(df.where(F.col(id_col) == query_id)).first()
    q = found["vector"] if found is not None else [0.0] * hashing.DIMENSIONS
    others = embedded(df.where(F.col(id_col) != query_id)).where(F.exists("vector", lambda x: x != 0))
    return others.select(id_col, F.round(vectors.dot(F.col("vector"), literal_vector(q)), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def embed_text(texts: str, *, dimensions: int = 64) -> list[float]:
    """The SHA-256 hash embedding of one query text, on the driver."""
    import hashlib
    import math

    v = [0.0] * dimensions
    for t in texts.lower().split():
        v[int(hashlib.sha256(t.encode()).hexdigest(), 16) % dimensions] += 1
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def keyword_filter(df: DataFrame, words: Sequence[str], *, text_col: str = "text") -> DataFrame:
    """Rows that hold every word as a token; no words, no rows. One scan, no shuffle: the posting sets meet inside each row."""
    if not words:
        return df.where(F.lit(False))
    have = text.tokens(F.col(text_col))
    hit = F.array_contains(have, words[0].lower())
    for w in words[1:]:
        hit = hit & F.array_contains(have, w.lower())
    return df.where(hit)


def hybrid(df: DataFrame, words: Sequence[str], query: str, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): rows with all words, ranked by cosine of their hash embedding to the query's."""
    matched = hash_embeddings(keyword_filter(df, words, text_col=text_col), id_col=id_col, text_col=text_col)
    score = F.round(vectors.dot(F.col("vector"), literal_vector(embed_text(query))), 6)
    return matched.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def any_column_contains(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns holds the query, case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
    return df.where(hit)


def alias_match(df: DataFrame, name_col: str, *, contains: str | None = None, regex: str | None = None) -> DataFrame:
    """Rows whose name or any alias contains a text and matches a regular expression, case aside."""
    names = text.aliases(F.col(name_col))
    if contains is not None:
        df = df.where(F.exists(names, lambda a: F.lower(a).contains(contains.lower())))
    return df if regex is None else df.where(F.exists(names, lambda a: a.rlike(f"(?i){regex}")))


def word_overlap(df: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, id, overlap): the k texts that share most distinct words with each query text; texts without a common word take no
    part. The queries, whose number is checked, go to every task; a task passes on its k best texts of each query. Their words meet the
    texts' words in blocks of MATRIX values."""
    asked = queries.select(F.col(query_id).alias("q"), F.array_distinct(text.ascii_words(F.col(query_text))).alias("w")).limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries at a time")
    known = df.sparkSession.sparkContext.broadcast(asked)

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        places = np.array([(number.setdefault(w, len(number)), i) for i, r in enumerate(known.value) for w in r["w"] or ()], np.int64).reshape(-1, 2)
        places = places[np.argsort(places[:, 0], kind="stable")]
        step = max(1, MATRIX // max(1, len(known.value)))
        vocabulary = pa.array(list(number), pa.string())
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(1)
                at = pc.index_in(lists.flatten(), vocabulary)
                rows = np.repeat(np.arange(part.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                rows, at = rows[hit], at.drop_null().to_numpy()
                shared = np.zeros((part.num_rows, len(known.value)), np.int64)
                for word in np.unique(at // step).tolist():  # blocks of words that these texts have
                    own, some = at // step == word, places[slice(*np.searchsorted(places[:, 0], [word * step, (word + 1) * step]))]
                    have, held = np.zeros((part.num_rows, step), np.float32), np.zeros((step, len(known.value)), np.float32)
                    have[rows[own], at[own] - word * step] = 1
                    held[some[:, 0] - word * step, some[:, 1]] = 1
                    shared += (have @ held).astype(np.int64)
                order = np.argsort(-shared, axis=0, kind="stable")  # rows come in order of their id
                top = order[:k]
                text_at, query_at = top.reshape(-1), np.tile(np.arange(shared.shape[1]), len(top))
                some = shared[text_at, query_at] > 0
                ids = part.column(0).take(pa.array(text_at[some]))
                yield pa.RecordBatch.from_arrays([pa.array([known.value[i]["q"] for i in query_at[some].tolist()], kind), ids, pa.array(shared[text_at, query_at][some])], ["query_id", id_col, "overlap"])

    kind = to_arrow_type(queries.schema[query_id].dataType)
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField(id_col, df.schema[id_col].dataType), T.StructField("overlap", T.LongType())])
    found = df.select(id_col, F.array_distinct(text.ascii_words(F.col(text_col))).alias("_w")).sortWithinPartitions(id_col).mapInArrow(best_of, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("overlap"), id_col)
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
