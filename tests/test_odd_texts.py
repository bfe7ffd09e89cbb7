"""Queries against their SQL on texts that the smallest tables don't have."""

import duckdb
import pytest

from lexmill.functions.vectors import token_sign_and_bucket
from lexmill.plans.registry import ORACLES, QUERIES


def opposite(size=64):
    """Two words of one bucket and opposite signs."""
    seen = {}
    for n in range(10_000):
        place, sign = token_sign_and_bucket(f"w{n}", size)
        if (place, -sign) in seen:
            return seen[place, -sign], f"w{n}"
        seen.setdefault((place, sign), f"w{n}")


def compare(spark, folder, name, tables):
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    show = lambda f: (sorted(f.columns), sorted(map(tuple, f[sorted(f.columns)].astype(str).values.tolist())))
    assert show(QUERIES[name](spark, str(folder)).toPandas()) == show(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["rrf_fusion", "hybrid_search", "rewritten_recall", "golden_hits"])
def test_words_that_cancel_out(spark, tmp_path, name):
    """A vector of length 0 has no cosine; a text without words has no vector."""
    a, b = opposite()
    docs = [(i, " ".join(f"k{(i * j) % 50}" for j in range(2, 9)), "en", "src1") for i in range(40)] + [(40, f"{a} {b}", "de", "src2"), (41, "!!", "fr", "src3"), (42, f"{b} {a} {a} {b}", "es", "src1"), (43, "k60 k61 k62 k63 k64 k65 k66", "en", "src1")]
    items = [(1, "k1 k2 k3 k4 k5 k6 k7"), (2, "k8 k9 k10 k11 k12 k13"), (3, f"k4 k8 k12 k16 {a} {b}"), (5, "k60 k61 k62 k63 k64 k65 k66")]
    compare(spark, tmp_path, name, {"documents": (docs, "doc_id long, text string, lang string, source string"), "benchmark": (items, "item_id long, text string")})


@pytest.mark.parametrize("name", ["html_to_text", "page_sections"])
def test_references_that_break_off(spark, tmp_path, name):
    pages = [
        (1, "<h1>The&amp;&amp;&amp</h1><p>cut &am &amp &quo &lt &copy 2 &amp;lt; &copy;</p>"), (2, "<h2>a&amp&amp;b</h2>x &middot; y &amp"), (3, "<p>&</p>&amp;amp"), (4, ""), (5, "<h1>t</h1>&;&#39;&#39"),
    ]
    compare(spark, tmp_path, name, {"pages": (pages, "page_id long, html string")})
