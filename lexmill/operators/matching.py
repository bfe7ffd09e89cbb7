"""Which texts hold which patterns: both are tables of any size, joined by a signature of each pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import stage

#: Characters of a signature.
GRAM = 4
#: Signatures up to which their table goes to every worker, so that no other run of a text is shuffled.
SENT_GRAMS = 200_000


def grams(text: Column, size: int) -> Column:
    """Different runs of `size` characters, told in one pass; none where the text is shorter. A run that begins within a
    character of two code units is no run of the text, which adds a signature that nothing asks for."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def containing(texts: DataFrame, patterns: DataFrame, key: str, text: str, ord_: str, pattern: str, gram: int = GRAM) -> DataFrame:
    """(key, ord): which texts hold which patterns, once a pair; the exact result of a join on contains(), without its nested loop.

    A pattern's signature is the one of its runs of `gram` characters that the fewest texts hold (all of it, if it is
    shorter); a text that holds the pattern holds its signature, so an equality join on the signature loses none, and
    contains() decides on what it leaves. Signatures that no text holds drop out with their patterns. Empty and null
    patterns and texts match nothing. Keys are unique in their tables.
    """
    wanted = patterns.select(F.col(ord_).alias("ord"), F.col(pattern).alias("pattern")).filter(F.length("pattern") > 0)
    given = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    sizes = range(1, gram + 1)
    of_pattern = wanted.select("ord", "pattern", F.explode(grams_of_size(F.col("pattern"), gram)).alias("gram"))
    # texts are cut into runs of those sizes only that some pattern asks for
    short = {r[0] for r in of_pattern.select(F.length("gram")).distinct().collect()}
    cut = given.select("key", F.explode(F.concat(*(grams(F.col("text"), s) for s in sizes if s in short), F.array().cast("array<string>"))).alias("gram"))
    asked = stage(of_pattern.select("gram").distinct(), "grams")
    # the texts are cut once, and only runs that some pattern asks for go on
    found = stage(cut.join(F.broadcast(asked) if asked.count() <= SENT_GRAMS else asked, "gram", "left_semi"), "found-grams")
    held = found.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = of_pattern.join(held, "gram", "left").groupBy("ord", "pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least"))
    signed = rarest.filter(F.col("least.texts") > 0).select("ord", "pattern", F.col("least.gram").alias("gram"))
    meeting = found.join(signed, "gram").select("key", "ord", "pattern")
    return meeting.join(given, "key").filter(F.contains("text", "pattern")).select(F.col("key").alias(key), F.col("ord").alias(ord_))


def grams_of_size(pattern: Column, gram: int) -> Column:
    """Runs that can sign a pattern: those of `gram` characters, or the whole of a shorter one."""
    return F.when(F.length(pattern) < gram, F.array(pattern)).otherwise(grams(pattern, gram))


def first_matches(texts: DataFrame, patterns: DataFrame, key: str, text: str, ord_: str, pattern: str) -> DataFrame:
    """(key, ord, matches): the first pattern by `ord` that each text holds, and how many it holds; texts without any stay out."""
    pairs = containing(texts, patterns, key, text, ord_, pattern)
    return pairs.groupBy(key).agg(F.min(ord_).alias(ord_), F.count("*").alias("matches"))
