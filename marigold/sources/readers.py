"""Sources: Parquet, CSV, JSON and text, with column detection for profile and vector files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigold.functions import text

# Column names that hold an identifier or a vector, in order of preference.
ID_COLUMNS = ("cid", "profile_cid", "pid", "id", "profile_id", "uuid", "uid")
VECTOR_COLUMNS = ("vector", "embedding", "embeddings", "vec", "values")
#: What Spark says of files that are no Parquet.
CORRUPT = re.compile(r"is not a Parquet file|CANNOT_READ_FILE_FOOTER|FAILED_READ_FILE\.CANNOT_READ_FILE_FOOTER|UNABLE_TO_INFER_SCHEMA|corrupt", re.I)
#: Stands for a quoted empty text while CSV is parsed: no character, by Unicode's rules.
EMPTY = "\ufdd0"
ID_PATTERN = re.compile(r"(^|_)(cid|uuid|uid|id)$", re.I)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by the file system that serves it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, *, skip_corrupt: bool = False) -> DataFrame:
    """A Parquet table; a missing one is an empty table of the schema. skip_corrupt leaves unreadable files out instead of failing."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], typed)
    return spark.read.schema(typed).option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path)


def quarantine(spark: SparkSession, path: str, stamp: int) -> str | None:
    """Moves a table that is no Parquet to <path>.corrupt.<stamp>; returns the new path, or None if it can be read.

    Any other failure, such as a missing permission or a lost connection, is raised and moves nothing."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return None
    except Exception as failure:
        if not CORRUPT.search(str(failure)):
            raise
        jvm = spark.sparkContext._jvm
        source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.corrupt.{stamp}")
        source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target)
        return f"{path}.corrupt.{stamp}"


def by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV with a header, by the path's suffix."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    for suffix, read in ((".parquet", reader.parquet), (".orc", reader.orc), (".json", reader.json), (".jsonl", reader.json)):
        if path.lower().rstrip("/").endswith(suffix):
            return read(path)
    return csv(spark, path, schema)


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, doubled quotes, outer spaces, and line ends inside quotes; without a schema, all columns are text.

    A pair of quotes is an empty text, nothing at all is null; a text that is EMPTY alone counts as empty, too."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue=EMPTY)
    rows = (reader.schema(schema) if schema is not None else reader).csv(path)
    return rows.select(*(F.when(F.col(f"`{f.name}`") == EMPTY, "").otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in rows.schema))


def documents(spark: SparkSession, root: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """(path, text): whole files under a folder, of any depth."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def as_view(df: DataFrame, name: str) -> int:
    """Registers a temporary view and gives its row count."""
    df.createOrReplaceTempView(name)
    return df.count()


def id_column(columns: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[c] for c in ID_COLUMNS if c in lower), next((c for c in columns if ID_PATTERN.search(c)), None))


def vector_layout(schema: T.StructType) -> tuple[str, list[str]] | None:
    """("list" | "json" | "wide", columns): an array column, a JSON text column, or at least eight numbered columns v0, v1, ..."""
    lower = {f.name.lower(): f for f in schema.fields}
    for name in VECTOR_COLUMNS:
        f = lower.get(name)
        if f is not None and isinstance(f.dataType, T.ArrayType):
            return "list", [f.name]
        if f is not None and isinstance(f.dataType, T.StringType):
            return "json", [f.name]
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            return "list", [f.name]
    wide = sorted((int(m[1]), f.name) for f in schema.fields if (m := re.fullmatch(r"(?:v|dim_?|emb_?)(\d+)", f.name, re.I)) and isinstance(f.dataType, T.NumericType))
    return ("wide", [name for _, name in wide]) if len(wide) >= 8 else None


def vectors(df: DataFrame) -> DataFrame:
    """(cid, vector) from any of the three layouts; rows without a vector go."""
    key, layout = id_column(df.columns), vector_layout(df.schema)
    if layout is None:
        raise ValueError("no vector column found")
    kind, columns = layout
    if kind == "list":
        v: Column = F.transform(F.col(f"`{columns[0]}`"), lambda x: x.cast("double"))
    elif kind == "json":
        v = F.from_json(F.col(f"`{columns[0]}`"), "array<double>")
    else:
        v = F.array(*(F.col(f"`{c}`").cast("double") for c in columns))
    cid = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    return df.select(cid.alias("cid"), v.alias("vector")).where("vector IS NOT NULL AND size(vector) > 0")


def profiles(df: DataFrame) -> DataFrame:
    """(cid, name, description, mbti, socionics, big5, text): synonyms coalesced, and a text of all of them."""
    have = {c.lower(): c for c in df.columns}

    def pick(keys: Sequence[str]) -> Column:
        found = [F.nullif(F.nullif(F.trim(F.col(f"`{have[k]}`").cast("string")), F.lit("")), F.lit("nan")) for k in keys if k in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    key = id_column(df.columns)
    named = {"name": pick(text.NAME_KEYS), "description": pick(text.DESCRIPTION_KEYS)} | {f: pick(keys) for f, keys in text.TYPE_KEYS.items()}
    out = df.select((F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")).alias("cid"), *(c.alias(n) for n, c in named.items()))
    return out.withColumn("text", F.concat_ws(" ", "name", "mbti", "socionics", "big5", "description"))


def with_names(df: DataFrame, names: DataFrame, key: str = "cid") -> DataFrame:
    """df with missing names filled in from another table, one name per key."""
    other = names.where("name IS NOT NULL AND trim(name) <> ''").groupBy(key).agg(F.min("name").alias("_name"))
    return df.join(other, key, "left").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "_name")).drop("_name")


def parsed_payloads(df: DataFrame, schema: str, payload_col: str = "payload_bytes") -> DataFrame:
    """df with `payload` parsed from JSON bytes or text; rows that are not JSON objects go."""
    return df.withColumn("payload", F.from_json(F.col(payload_col).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("payload IS NOT NULL")


def encode_vector(vector: Column) -> Column:
    """A vector of floats as text of comma-separated numbers, the portable form of a binary column."""
    return F.array_join(F.transform(vector, lambda x: x.cast("float").cast("string")), ",")


def decode_vector(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ","), lambda x: x != ""), lambda x: x.cast("float"))
