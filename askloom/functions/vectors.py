"""Distances between array columns and hashed term vectors, all ``Column -> Column``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

try:
    from _md5 import md5  # several times as fast as that of hashlib, which asks OpenSSL for each text
except ImportError:
    from hashlib import md5

DECIMALS = 6
HASH_DIM = 1024
# Tokens counted in one sort; a longer row is sorted alone.
COUNT_TOKENS = 500_000


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    squares = F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def rounded(d: Column) -> Column:
    """Round a distance for ranking; a negative zero becomes zero."""
    r = F.round(d, DECIMALS)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def cosine_distance(a: Column, b: Column) -> Column:
    """0..2; NULL if either vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def ip_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


DISTANCES = {"cosine": cosine_distance, "l2": l2_distance, "ip": ip_distance}


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector becomes an array of NULLs."""
    length = norm(v)
    return F.transform(_doubles(v), lambda x: F.try_divide(x, length))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def token_bucket(token: Column, dim: int = HASH_DIM) -> Column:
    code = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (code % dim).cast("int")


def word_buckets(words: pa.Array, dim: int = HASH_DIM) -> np.ndarray:
    """``token_bucket`` of binary strings."""
    digests = b"".join([md5(w).digest() for w in words.to_numpy(zero_copy_only=False)])
    return (np.frombuffer(digests, ">u4")[::4] % dim).astype(np.int64)


def count_buckets(dim: int = HASH_DIM):
    """Arrow UDF on the tokens of each row: their distinct buckets (see ``token_bucket``), ascending, and how often each occurs.

    Rows are counted many in one sort, and each distinct token among them is hashed once.
    """

    def part(tokens: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        words = tokens.flatten().cast(pa.binary()).dictionary_encode()
        values = word_buckets(words.dictionary, dim)[words.indices.to_numpy()]
        pairs, tf = np.unique(row * dim + values, return_counts=True)
        ends = np.concatenate(([0], np.cumsum(np.bincount(pairs // dim, minlength=len(sizes)))))
        offsets = pa.array(ends.astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(part.astype(np.int32)))
            for part in (pairs % dim, tf)
        ]
        return pa.StructArray.from_arrays(lists, ["buckets", "tf"])

    @arrow_udf("struct<buckets:array<int>,tf:array<int>>")
    def counted(tokens: pa.Array) -> pa.Array:
        before = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()) // COUNT_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(tokens)]
        return pa.concat_arrays([part(tokens.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return counted


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log((1 + n_chunks) / (1 + df)) + 1
