"""The chunk table: idempotent merge, pruning, sweeping and statistics as joins over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_json(rows: DataFrame) -> Column:
    """A row as text, by its columns in the order of their names."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))))


def apart(rows: DataFrame, key: list[str]) -> Column:
    """What tells rows with a null in their key apart, as the key doesn't: the row's digest; empty for others."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"`{k}`").isNull()
    return F.when(missing, F.md5(row_json(rows).cast("binary"))).otherwise("")


def last_of_key(rows: DataFrame, key: str | list[str], order: Column | None = None) -> DataFrame:
    """One row a key: the highest by `order` (nulls count lowest); ties, and all without an order, go by the row's digest, so
    the choice doesn't depend on the order of rows. A maximum, taken before the shuffle: no key falls to one task.

    A null in a key names no row: of such rows only equal ones count as one."""
    keys = [key] if isinstance(key, str) else key
    digest = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))
    by = F.struct(*([order.alias("order")] if order is not None else []), digest.alias("digest"))
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*keys, apart(rows, keys).alias("__apart")).agg(F.max_by(whole, by).alias("last")).select("last.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Incoming rows replace current rows of the same key; all columns are taken over. Twice gives the same as once.

    Of incoming rows with the same key one stays (last_of_key). A row with a null key replaces only rows equal to it.
    """
    fresh = last_of_key(incoming, key, order)
    marked = current.withColumn("__apart", apart(current, [key])).alias("a")
    written = fresh.select(F.col(key).alias("__key"), apart(fresh, [key]).alias("__written"))
    same = F.col(f"a.{key}").eqNullSafe(F.col("__key")) & (F.col("__apart") == F.col("__written"))
    return marked.join(written, same, "left_anti").select(*(F.col(f"a.`{c}`") for c in current.columns)).unionByName(fresh)


def prune(current: DataFrame, sources: DataFrame, keep: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Without rows of the re-read sources whose key was not written again."""
    stale = current.join(sources, scope, "left_semi").join(keep, [*scope, key], "left_anti").select(*scope, key)
    return current.join(stale, [*scope, key], "left_anti")


def sweep(current: DataFrame, active: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of active sources only; with no active source at all nothing is swept.

    Whether there is any is a subquery of the same plan: nothing runs until the result is asked for.
    """
    known = active.select(*scope).distinct().withColumn("__active", F.lit(True))
    none = ~active.select(F.lit(1)).limit(1).exists()
    return current.join(known, scope, "left").filter(F.col("__active") | none).select(*(F.col(f"`{c}`") for c in current.columns))


def source_statistics(chunks: DataFrame, title: str = "title", role: str = "role") -> DataFrame:
    return chunks.groupBy("school", "source").agg(F.count("*").alias("chunks"), F.max(title).alias("title"), F.max(role).alias("role"))


def changed_sources(current: DataFrame, state: DataFrame, key: str, force: bool = False) -> DataFrame:
    """(key, status) against stored fingerprints: new, changed or unchanged; with `force` nothing counts as unchanged.

    The state may hold several rows a key, one for each document that a source gave: a source is unchanged only if all
    of them carry its fingerprint.
    """
    lowest, highest = F.min(F.coalesce("fingerprint", F.lit(""))).alias("lowest"), F.max(F.coalesce("fingerprint", F.lit(""))).alias("highest")
    both = current.join(state.groupBy(key).agg(lowest, highest), key, "left")
    same = F.lit(not force) & (F.col("lowest") == F.col("fingerprint")) & (F.col("highest") == F.col("fingerprint"))
    status = F.when(F.col("lowest").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))
