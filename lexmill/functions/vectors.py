"""Vector expressions over array columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector, 1 for the null vector."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, size).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def fit_dimension(a: Column, size: int) -> Column:
    """Cut or pad with zeros, then scale to length 1."""
    fitted = F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)
    return F.transform(fitted, lambda x: x / norm(fitted))


#: Items of lists that a worker takes at once, about; what it makes of them takes some 100 bytes an item.
ITEMS = 250_000


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = ITEMS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the lists of a column hold about `most` items together, one row at least: the arrays made of a
    piece have a bound that doesn't depend on how many rows come at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def token_sign_and_bucket(token: str, size: int) -> tuple[int, float]:
    """Bucket of a token, the first eight hex digits of its MD5 modulo the dimension, and a sign by the lowest bit of the
    ninth."""
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:8], 16) % size, 1.0 if int(digest[8], 16) & 1 else -1.0


def hash_vectors(rows: DataFrame, tokens: Column, key: str, size: int) -> DataFrame:
    """(key, raw, touched): signed 1 + ln(tf) of each row's tokens summed by bucket, and which buckets a token fell into.

    A vector depends on its row alone, so nothing is shuffled: the tokens are made in the JVM, Arrow numbers the different
    ones of a batch, and each of them is hashed once a batch. Null tokens give the null vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            bags = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            sizes = pc.list_value_length(bags).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = bags.flatten().dictionary_encode()
            hashed = [token_sign_and_bucket(t, size) for t in coded.dictionary.to_pylist()]
            place, sign = np.array([h[0] for h in hashed], np.int64), np.array([h[1] for h in hashed])
            wide = max(1, len(hashed))
            both, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, token = np.divmod(both, wide)
            cell = row * size + place[token] if len(hashed) else row
            raw = np.bincount(cell, weights=(sign[token] if len(hashed) else 0.0) * (1 + np.log(tf)), minlength=len(sizes) * size)
            touched = np.bincount(cell, minlength=len(sizes) * size) > 0
            ends = pa.array(np.arange(len(sizes) + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(raw)), pa.ListArray.from_arrays(ends, pa.array(touched))], names=[key, "raw", "touched"])

    return rows.select(F.col(key).cast("long"), tokens.alias("bag")).mapInArrow(run, f"{key} long, raw array<double>, touched array<boolean>")


def unit_vectors(raw: DataFrame, key: str) -> DataFrame:
    """(key, vector) of length 1 from (key, raw) rows; null vectors stay."""
    return raw.select(key, let(norm(F.col("raw")), lambda n: F.transform("raw", lambda x: x / n)).alias("vector"))
