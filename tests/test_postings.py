import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import words
from lexmill.operators.postings import PostingsIndex, impact, peaks, postings_top_k
from lexmill.operators.retrieval import bm25_top_k
from lexmill.session import remove, scratch, shared_dir, stage


def corpus(spark, n, seed=0, first=0):
    """Texts over a skewed vocabulary; some null, empty or long."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(first, first + n):
        size = rng.choice([0, 1, 5, 20, 60, 2000 if i % 97 == 0 else 30])
        rows.append((i, None if i % 41 == 0 else " ".join(rng.choices(vocabulary, weight, k=size)), "en"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def terms(spark, n, seed=9):
    rng = random.Random(seed)
    return spark.createDataFrame([(q, f"w{t}") for q in range(n) for t in {rng.randrange(400) if rng.random() < 0.7 else rng.randrange(5) for _ in range(6)}] + [(n, "unknown")], "query_id long, token string")


def same(a, b):
    assert sorted(map(tuple, a.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, b.select("query_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize(("slice_", "k", "seeds"), [(32, 5, 4), (3, 1, 1), (1, 200, 2)])
def test_equals_a_scan(spark, slice_, k, seeds):
    docs, queries = corpus(spark, 900), terms(spark, 25)
    index = PostingsIndex(spark, slice_=slice_)
    index.append(docs, words(F.col("text")), 0)
    report = {}
    same(postings_top_k(index, queries, k, seeds=seeds, report=report), bm25_top_k(docs, words(F.col("text")), queries, k))
    assert 0 < report["scored"] <= report["postings"]
    if k == 1:
        assert report["scored"] < 0.5 * report["postings"]


def test_query_blocks(spark, monkeypatch):
    docs, queries = corpus(spark, 300), terms(spark, 25)
    index = PostingsIndex(spark)
    index.append(docs, words(F.col("text")), 0)
    want = bm25_top_k(docs, words(F.col("text")), queries, 4)
    monkeypatch.setattr("lexmill.operators.postings.TERM_BLOCK", 30)
    same(postings_top_k(index, queries, 4), want)


def test_batches(spark):
    """Appending leaves earlier files as they are; a batch given again changes nothing; one without its last part isn't seen."""
    docs, more, queries = corpus(spark, 200), corpus(spark, 150, 5, 1000), terms(spark, 10)
    index = PostingsIndex(spark)
    index.append(docs, words(F.col("text")), 0)
    files = set(index.postings().inputFiles())
    index.append(more, words(F.col("text")), 1)
    assert files < set(index.postings().inputFiles())
    index.append(more, words(F.col("text")), 1)
    both = docs.unionByName(more)
    again = PostingsIndex(spark, index.path)
    assert again.batches() == [0, 1]
    same(postings_top_k(again, queries, 5), bm25_top_k(both, words(F.col("text")), queries, 5))
    index.append(corpus(spark, 50, 6, 5000), words(F.col("text")), 2)
    remove(spark, f"{index.path}/slices/batch=2/_SUCCESS")
    assert again.batches() == [0, 1]
    same(postings_top_k(again, queries, 5), bm25_top_k(both, words(F.col("text")), queries, 5))
    df = {r["term"]: r["df"] for r in again.frequencies().collect()}
    want = both.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").count()
    assert df == {r["term"]: r["count"] for r in want.collect()}


def test_nothing(spark):
    docs, queries = corpus(spark, 30), terms(spark, 3)
    empty = PostingsIndex(spark)
    assert postings_top_k(empty, queries, 3).count() == 0
    empty.append(docs.limit(0), words(F.col("text")), 0)
    assert postings_top_k(empty, queries, 3).count() == 0
    index = PostingsIndex(spark)
    index.append(docs, words(F.col("text")), 0)
    assert postings_top_k(index, queries.limit(0), 3).count() == 0
    assert postings_top_k(index, queries.filter("token = 'unknown'"), 3).count() == 0


def test_peaks_bound_every_posting():
    rng = np.random.default_rng(2)
    block = np.sort(rng.integers(0, 30, 500))
    tf, dl = rng.integers(1, 9, 500), rng.integers(1, 300, 500)
    _, block = np.unique(block, return_inverse=True)
    top = peaks(block, tf, dl)
    assert len(top) < 300
    for mean in (1.0, 20.0, 500.0):
        for b in range(block.max() + 1):
            assert np.isclose(impact(tf[block == b], dl[block == b], mean).max(), impact(tf[top[block[top] == b]], dl[top[block[top] == b]], mean).max())


def test_a_common_term_falls_to_several_tasks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text")).repartition(4)
    index = PostingsIndex(spark, slice_=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    index.append(docs, words(F.col("text")), 0)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    blocks = index.postings().filter("term = 'same'").select(F.input_file_name().alias("f"))
    assert blocks.count() >= 1000 and blocks.distinct().count() > 1


def test_scratch_belongs_to_a_session(spark):
    other = spark.newSession()
    with scratch(spark):
        mine = stage(spark.range(3), "mine").inputFiles()[0]
        theirs = stage(other.range(3), "theirs")
    assert theirs.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(mine)


def test_blocks_of_other_slices(spark, monkeypatch):
    """Blocks whose slice isn't named are passed over where the slices' numbers are too many to be broadcast."""
    docs, queries = corpus(spark, 400), terms(spark, 12)
    index = PostingsIndex(spark, slice_=4)
    index.append(docs, words(F.col("text")), 0)
    monkeypatch.setattr("lexmill.operators.postings.BROADCAST_SLICES", 0)
    same(postings_top_k(index, queries, 3), bm25_top_k(docs, words(F.col("text")), queries, 3))


def test_blocks_are_in_no_shuffled_join(spark, monkeypatch):
    """The postings are shuffled once, by slice; they meet their words and slices by declared broadcasts alone, which Spark has
    ready before the shuffle begins."""
    plans = []
    docs, queries = corpus(spark, 300), terms(spark, 8)
    kind, real = type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: plans.append(self) or real(self, *a, **k))
    index = PostingsIndex(spark)
    index.append(docs, words(F.col("text")), 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        postings_top_k(index, queries, 3)
        scored = [p for p in (f._jdf.queryExecution().executedPlan().toString() for f in plans) if "REPARTITION_BY_COL" in p]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(scored) == 2 and not any("SortMergeJoin" in p for p in scored)


def test_only_the_index_and_the_result_stay(spark):
    docs, queries = corpus(spark, 300), terms(spark, 8)
    place = Path(shared_dir(spark).removeprefix("file:"), "lexmill")
    before = set(place.iterdir()) if place.exists() else set()
    with scratch(spark):
        index = PostingsIndex(spark)
        index.append(docs, words(F.col("text")), 0)
        found = postings_top_k(index, queries, 3)
        assert sorted(p.name.split("-")[0] for p in set(place.iterdir()) - before) == ["found", "postings"]
        assert found.count() > 0
