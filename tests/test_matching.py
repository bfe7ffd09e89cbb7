import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.corpus import resolve_titles
from lexmill.operators.matching import containing, first_matches


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_theta_join(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc中🙂 ") for _ in range(rng.choice([1, 2, 3, 4, 5, 9])))
    texts = [(k, "".join(word() for _ in range(rng.randrange(0, 12)))) for k in range(120)] + [(900, None), (901, ""), (902, "abc" * 30_000)]
    patterns = [(k, word()) for k in range(150)] + [(800, None), (801, ""), (802, "never there")]
    a, b = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(patterns, "ord long, p string")
    got = [tuple(r) for r in containing(a, b, "id", "t", "ord", "p").collect()]
    want = [(k, o) for k, t in texts for o, p in patterns if t and p and p in t]
    assert sorted(got) == sorted(want)
    firsts = {r["id"]: (r["ord"], r["matches"]) for r in first_matches(a, b, "id", "t", "ord", "p").collect()}
    assert firsts == {k: (min(o for i, o in want if i == k), sum(i == k for i, _ in want)) for k in {i for i, _ in want}}


def test_fifty_thousand_patterns_without_a_nested_loop(spark):
    patterns = spark.range(50_000).select(F.col("id").alias("ord"), F.concat(F.lit("code-"), F.col("id"), F.lit(";")).alias("p"))
    texts = spark.range(500).select("id", F.concat(F.lit("has code-"), F.col("id") * 100, F.lit("; and code-"), F.col("id") * 7 + 1, F.lit("; in it")).alias("t"))
    pairs = containing(texts, patterns, "id", "t", "ord", "p")
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert sorted(map(tuple, pairs.collect())) == sorted({(k, k * 100) for k in range(500)} | {(k, k * 7 + 1) for k in range(500)})


def test_titles_both_ways(spark):
    registry = spark.createDataFrame([("伤寒论", "s"), ("伤寒论注解全书", "t"), ("abcd", "a"), ("ab", "b")], "book_title string, slug string")
    titles = spark.createDataFrame([("伤寒论",), ("注解全书",), ("xx abcd yy",), ("ab x",), ("none of it",), (None,), ("注解全书",)], "title string")
    found = resolve_titles(titles, registry)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert {r["title"]: (r["slug"], r["how"]) for r in found.collect()} == {
        "伤寒论": ("s", "exact"), "注解全书": ("t", "contained"), "xx abcd yy": ("a", "contained"), "ab x": (None, "none"), "none of it": (None, "none"), None: (None, "none"),
    }


def test_texts_are_cut_once(spark):
    """Runs of the texts that some pattern asks for are kept, not made again for each use."""
    texts, patterns = spark.createDataFrame([(1, "abcdefg"), (2, "xyz")], "k long, t string"), spark.createDataFrame([(5, "cdef"), (6, "yz"), (7, "q")], "o long, p string")
    found = containing(texts, patterns, "k", "t", "o", "p")
    assert any("found-grams" in f for f in found.inputFiles())
    assert sorted(map(tuple, found.collect())) == [(1, 5), (2, 6)]
