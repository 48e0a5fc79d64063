"""Hashes and content identifiers as column expressions; canonical JSON and hash embeddings are computed in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64
_FNV_START, _FNV_PRIME, _LOW32 = 2166136261, 16777619, 4294967295


def sha_bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """SHA-256 of the token, a number of 256 bits, modulo any number of dimensions up to 2**31 - 1."""
    if not 1 <= dimensions < 1 << 31:
        raise ValueError("dimensions is from 1 to 2**31 - 1")
    digest = F.sha2(token.cast("binary"), 256)
    if dimensions <= 256 and not dimensions & (dimensions - 1):  # divides 256: the last byte's low bits decide
        return F.conv(F.substring(digest, 63, 2), 16, 10).cast("int") % dimensions
    limbs = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.conv(F.substring(F.concat(F.lit("000000"), digest), i * 7 + 1 + F.lit(7), F.lit(7)), 16, 10).cast("long"))  # 63 of 70 digits, in sevens
    first = F.conv(F.substring(F.concat(F.lit("000000"), digest), 1, 7), 16, 10).cast("long")
    return F.aggregate(limbs, first % dimensions, lambda r, x: (r * (1 << 28) + x) % dimensions).cast("int")


def hashed_vectors(words: Column, kind: str = "sha256", dimensions: int = DIMENSIONS) -> Column:
    """The L2-normalised counts of an array of words by bucket, as an array of doubles; without words, zeros.

    Words come in Arrow batches; each distinct word of a batch is hashed once."""

    def sha(word: str) -> int:
        return int.from_bytes(hashlib.sha256(word.encode()).digest()) % dimensions

    def fnv(word: str) -> int:
        h = _FNV_START
        for c in word.encode():
            h = (h ^ c) * _FNV_PRIME & _LOW32
        return h % dimensions

    if kind not in ("sha256", "fnv1a"):
        raise ValueError("kind is 'sha256' or 'fnv1a'")
    bucket = sha if kind == "sha256" else fnv

    @F.arrow_udf("array<double>")
    def embedded(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(lists.flatten())
        buckets = np.fromiter((bucket(w) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        at = np.repeat(np.arange(len(lists)), lengths) * dimensions + buckets[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(at, minlength=len(lists) * dimensions).reshape(len(lists), dimensions).astype(float)
        norms = np.sqrt((counts * counts).sum(1, keepdims=True))
        flat = (counts / np.where(norms == 0, 1.0, norms)).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions), pa.array(flat))

    return embedded(words)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters of an ASCII string, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(_FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * _FNV_PRIME).bitwiseAND(F.lit(_LOW32).cast("long")))


def hash_coordinate(key: Column) -> Column:
    """A deterministic coordinate in [-1, 1): FNV-1a modulo 2000, in thousandths."""
    return (fnv1a(key) % 2000) / F.lit(1000.0) - 1


def salted_user_hash(salt: str, user_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), user_id.cast("string")).cast("binary"), 256), 1, 32)


def salted_token_hash(salt: str, token: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), token).cast("binary"), 256), 1, 16)


def cid_v1(payload: Column) -> Column:
    """CIDv1, raw codec, sha2-256, in base32: the header 01 55 12 20 and the digest, five bits to a character."""
    # 72 hexadecimal digits, padded to 80: ten of them are eight characters; of 64, 58 hold the 288 bits
    digits = F.array(F.concat(F.lit("01551220"), F.sha2(payload.cast("binary"), 256), F.lit("00000000")))
    octets = F.transform(digits, lambda h: F.concat(*(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(8))))
    return F.concat(F.lit("b"), F.translate(F.substring(F.element_at(octets, 1), 1, 58), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"))


@F.pandas_udf(T.StringType())
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with sorted keys and no spaces; top-level keys that begin with _ (provenance) left out; null where it is not JSON."""
    import json

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if isinstance(value, dict):
            value = {k: v for k, v in value.items() if not k.startswith("_")}
        return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    for s in texts:
        yield s.map(one)
