"""Retrieval evaluation: recall, reciprocal rank and isolation of ranked channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import half_up

# Thresholds of the validity checks.
RANDOM_AT_MOST, TIERED_AT_LEAST = 0.15, 0.60


def phrases_hit(content: Column, phrases: Column, strict: bool) -> Column:
    """All phrases (strict) or any phrase (loose) in the content."""
    inside = lambda p: F.contains(content, p)
    return F.forall(phrases, inside) if strict else F.exists(phrases, inside)


def channel_metrics(results: DataFrame, cases: DataFrame, hit: Column, isolated: Column) -> DataFrame:
    """(channel, recall, mrr, isolation, cases): results of (channel, case_id, rank, ...) against all cases.

    A case without results counts as missed and as isolated.
    """
    per_case = results.groupBy("channel", "case_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.bool_and(isolated).alias("isolated"))
    every = results.select("channel").distinct().join(cases.select("case_id").distinct())
    full = every.join(per_case, ["channel", "case_id"], "left")
    rank = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    return full.groupBy("channel").agg(
        half_up(F.avg(F.col("first").isNotNull().cast("double")), 3).alias("recall"), half_up(F.avg(rank), 3).alias("mrr"),
        half_up(F.avg(F.coalesce("isolated", F.lit(True)).cast("double")), 3).alias("isolation"), F.count("*").alias("cases"),
    )


def validity(metrics: DataFrame) -> DataFrame:
    """One row of checks over the channels random, tiered, flat, dense and sparse (the last two on paraphrases)."""
    of = lambda c: F.max(F.when(F.col("channel") == c, F.col("recall")))
    return metrics.agg(
        (of("random") <= RANDOM_AT_MOST).alias("random_is_low"), (of("tiered") >= TIERED_AT_LEAST).alias("tiered_is_high"),
        (of("tiered") > of("flat")).alias("tiered_beats_flat"), (of("sparse") <= of("dense")).alias("dense_adds"),
    )


def self_check(scores: DataFrame) -> DataFrame:
    """Share of queries whose own passage ranks first, and the least margin over the best other passage, from
    (query_id, passage_id, score). A query without its own passage failed; one without any other has no margin."""
    own = F.max(F.when(F.col("query_id") == F.col("passage_id"), F.col("score")))
    other = F.max(F.when(F.col("query_id") != F.col("passage_id"), F.col("score")))
    each = scores.groupBy("query_id").agg(own.alias("own"), other.alias("other"))
    return each.agg(F.avg(F.coalesce(F.col("own") > F.col("other"), F.col("own").isNotNull()).cast("double")).alias("top1"), F.min(F.col("own") - F.col("other")).alias("margin"))
