"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds more than one row in HOT_SHARE, so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def drawn(rows: DataFrame, content: list[str], sample: int, salt: str) -> DataFrame:
    """About `sample` of the rows, drawn by the hash of what they hold; never none where there are rows.

    Equal rows are drawn together. An id isn't among `content`: rows with a null or repeated id are drawn like others.
    """
    digest = F.xxhash64(F.lit(salt), *content)
    total, least = rows.agg(F.count("*"), F.min(digest)).first()
    return rows.filter((F.pmod(digest, F.lit(1_000_000)) / 1_000_000 < sample / max(1, total)) | (digest == F.lit(least)))


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their group, one group row for each key.

    Groups with more than total / HOT_SHARE rows number fewer than HOT_SHARE, whatever the input, so these are
    broadcast and their rows stay where they are. All other rows are joined by shuffling on the key.
    """
    limit = total // HOT_SHARE
    hot = groups.filter(F.col(size) > limit)
    rest = groups.filter(F.col(size) <= limit)
    hot_keys = F.broadcast(hot.select(*([key] if isinstance(key, str) else key)))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(hot_keys, key, "left_anti").join(rest, key))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so a task holds the Python objects of no more at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` and about `size` bytes of a text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            end = min(max(most, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at = end


def free_name(frame: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    held = {c.lower() for c in frame.columns}
    name = f"__{base}"
    while name in held:
        name += "_"
    return name


def column_place(schema: pa.Schema, name: str) -> int:
    """Place of a column by its name as Spark reads names: the same case first, else any case."""
    exact = schema.get_field_index(name)
    return exact if exact >= 0 else [x.lower() for x in schema.names].index(name.lower())
