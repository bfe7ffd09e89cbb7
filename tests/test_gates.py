import os

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import decode_entities
from lexmill.operators.build import published, sample_by_group
from lexmill.operators.retrieval import vocabulary


def statuses(spark, bad, good):
    return spark.createDataFrame([(k, "rejected: short") for k in range(bad)] + [(100 + k, "accepted") for k in range(good)] + [(500, None)], "id long, status string")


def test_a_run_is_published_or_leaves_no_trace(spark, tmp_path):
    target = str(tmp_path / "out")
    assert published(statuses(spark, 2, 1), F.col("status"), target) == {"rows": 4, "rejected": 2, "open": False}
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [100, 500]
    assert published(statuses(spark, 5, 3), F.col("status"), target) == {"rows": 9, "rejected": 5, "open": True}
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [100, 500] and os.listdir(tmp_path) == ["out"]
    assert published(statuses(spark, 5, 30), F.col("status"), target)["open"] is False
    assert spark.read.parquet(target).count() == 31 and os.listdir(tmp_path) == ["out"]
    assert published(statuses(spark, 1, 1).limit(0), F.col("status"), target) == {"rows": 0, "rejected": 0, "open": False}


def test_one_scan(spark, tmp_path):
    """The input is read once: a counter in it counts each row once."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = statuses(spark, 1, 9).mapInArrow(touch, "id long, status string")
    published(frame, F.col("status"), str(tmp_path / "out"))
    assert seen.value == 11


def test_samples(spark):
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("often").alias("g")).repartition(6)
    drawn = sample_by_group(rows, "g", "id", 200)
    assert "WindowGroupLimit" in drawn._jdf.queryExecution().toString()
    found = drawn.collect()
    assert {g: sum(r["g"] == g for r in found) for g in ("rare", "often")} == {"rare": 200, "often": 200}
    # each tenth of the ids gives its share, within four deviations
    for part in range(10):
        assert abs(sum(600 * part <= r["id"] < 600 * (part + 1) for r in found) - 40) < 4 * 40**0.5


@pytest.mark.parametrize("text", ["a &amp;lt; b", "&lt;b&gt; &quot;x&#39;&nbsp;&#x27;", "&amp;&amp;amp;", "&amp &lt", "&eacute;&amp;", "no mark", "", "&", "&amp;#39; &amp;nbsp;"])
def test_references_in_either_way(spark, text):
    import html

    assert spark.createDataFrame([(text,)], "t string").select(decode_entities(F.col("t"))).first()[0] == html.unescape(text)


def test_vocabulary(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],), (None,), (["c"] * 5,)], "t array<string>").repartition(2)
    assert sorted(map(tuple, vocabulary(rows, F.col("t")).collect())) == [("a", 2, 3), ("b", 1, 1), ("c", 1, 5)]
    assert vocabulary(rows.limit(0), F.col("t")).count() == 0
