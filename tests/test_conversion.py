"""Conversion by phrases against a slow version, by both ways of bringing the table to the texts."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import unify_lines
from lexmill.operators.conversion import TABLE_BYTES, converted, converter
from lexmill.operators.corpus import normalise


def slow(text, table):
    if text is None:
        return None
    out, at = "", 0
    while at < len(text):
        fitting = [p for p in table if p and text.startswith(p, at)]
        best = max(fitting, key=len) if fitting else None
        out, at = (out + text[at], at + 1) if best is None else (out + table[best], at + len(best))
    return out


def run(spark, texts, rows, most):
    docs = spark.createDataFrame(list(enumerate(texts)), "phrase int, text string")
    table = spark.createDataFrame(rows, "phrase string, replacement string")
    return [r[0] for r in converted(docs, table, "text", most).orderBy("phrase").select("text").collect()]


@pytest.mark.parametrize("most", [TABLE_BYTES, 0])
def test_equals_slow_version(spark, most):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab]^發头髮😀") for _ in range(draw.randint(1, n)))
    table = {word(6): draw.choice(["", "a", "发", "髮髮", "^"]) for _ in range(60)}
    texts = [word(80) for _ in range(120)] + [None, "", "zzz", "zzz", "a" * 200_000]
    assert run(spark, texts, list(table.items()), most) == [slow(t, table) for t in texts]


def test_longest_phrase_first(spark):
    table = [("头发", "頭髮"), ("发", "發"), ("头", "頭"), ("发展", "發展"), ("展", "展")]
    assert run(spark, ["头发发展", "发头", "梳头发"], table, TABLE_BYTES) == ["頭髮發展", "發頭", "梳頭髮"]


@pytest.mark.parametrize("most", [TABLE_BYTES, 0])
def test_odd_tables(spark, most):
    assert run(spark, ["ab", None, ""], [("a", "y"), ("a", "x"), ("", "z"), (None, "q"), ("b", None)], most) == ["xb", None, ""]
    assert run(spark, ["ab", None], [], most) == ["ab", None]
    assert run(spark, [], [("a", "x")], most) == []


def test_within_normalise(spark):
    table = spark.createDataFrame([("头发", "頭髮")], "phrase string, replacement string")
    put = converter(table)
    text = "头发长了很多，需要好好地梳理一番，然后再去见人，这是母亲常常说起的一句话，我们也一直都记在心里面。\r\n123\r\n"
    row = spark.createDataFrame([(text,)], "text string").select(normalise(F.col("text"), put(unify_lines(F.col("text")))).alias("t")).first()
    assert row["t"] == text.split("\r")[0].replace("头发", "頭髮")


def test_one_pattern_equals_the_loop():
    """Few phrases a first character are one pattern, many are looked up; both give the same."""
    from lexmill.operators.conversion import ALTERNATIVES, Phrases

    few = Phrases({"a": "1", "ab": "2", "abc|": "3", ".": "", "\n\n": "¶", "😀x": "a"})
    text = "abc|ab.a\n\n\n😀x abcab"
    found = few.put(text)
    assert few.whole is not None
    few.whole = None
    assert few.put(text) == found == "321¶\na 2c2"
    assert Phrases({"a" * n: "b" for n in range(1, ALTERNATIVES + 2)}).whole is None
    assert Phrases({}).put("x") == "x"
