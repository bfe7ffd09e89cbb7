from collections import Counter

from pyspark.sql import functions as F

from lexmill.llm import exact_dedup
from lexmill.llm.common import HOT_SHARE
from lexmill.llm.exact_dedup import DigestIndex, drop_duplicates, exact_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_groups(odd):
    rows = exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    groups = {}
    for r in odd.collect():
        groups.setdefault((r["text"] or "").translate(LOWER), []).append(r["doc_id"])
    sizes = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        sizes[max(known) if known else None, len(ids)] += len(ids)
    assert Counter((r["keep_id"], r["group_size"]) for r in rows) == sizes
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drops_with_all_columns(odd, nothing):
    kept = drop_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(LOWER) for r in odd.collect()})
    assert drop_duplicates(nothing).count() == 0 and exact_duplicates(nothing).count() == 0


def test_index_persists(spark, odd):
    """What came first stays; a second batch only adds what is new, and adding it again adds nothing."""
    index = DigestIndex(spark)
    first = exact_duplicates(odd, index).filter("kept").count()
    assert index.read().count() == first
    more = spark.createDataFrame([(50, "one"), (51, "brand new"), (52, "BRAND new")], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in exact_duplicates(more, index).collect()}
    assert kept == {50: False, 51: False, 52: True}
    assert index.read().count() == first + 1
    assert exact_duplicates(more, index).filter("kept").count() == 0
    assert index.read().count() == first + 1
    plan = spark._jvm.PythonSQLUtils.explainString(more.selectExpr("sha2(text, 256) digest").join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution(), "formatted")
    assert f"SelectedBucketsCount: {index.buckets} out of {index.buckets}" in plan


def test_small_batch_against_large_index(spark, monkeypatch):
    """Only the batch's own groups meet its rows, few of them by broadcast; sizes count the rows of all batches once."""
    seen, join = [], exact_dedup.join_groups

    def spy(rows, groups, key, size, total):
        seen.append((groups.count(), groups.filter(f"{size} > {total // HOT_SHARE}").count()))
        return join(rows, groups, key, size, total)

    monkeypatch.setattr(exact_dedup, "join_groups", spy)
    index = DigestIndex(spark)
    large = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id div 2) AS text")
    assert exact_duplicates(large, index).filter("kept").count() == 2500
    for batch, size in (([(9001, "text 7"), (9002, "Text 7"), (9003, "new")], 4), ([(9004, "text 7"), (9005, "new")], 5), ([(9004, "text 7"), (9005, "new")], 5)):
        rows = exact_duplicates(spark.createDataFrame(batch, "doc_id long, text string"), index).collect()
        assert seen[-1] == (2, 2)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(15, size), (9003, size - 3)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [9003] * (size == 4)
    assert index.read().count() == 2501


def test_index_outlives_the_catalog(spark, odd, tmp_path):
    """With the catalog's entry gone, as in a new session, the files are found again and nothing is written over them."""
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, buckets=8)
    assert not index.exists()
    first = exact_duplicates(odd, index).filter("kept").count()
    spark.sql(f"DROP TABLE {index.name}")
    again = DigestIndex(spark, path)
    assert again.exists() and again.buckets == 8
    more = spark.createDataFrame([(50, "one"), (51, "brand new")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in exact_duplicates(more, again).collect()} == {50: False, 51: True}
    assert again.read().count() == first + 1
    assert exact_duplicates(odd, again).filter("kept").count() == 0
    assert exact_duplicates(odd, again, resume=True).filter("kept").count() == first
    assert again.read().count() == first + 1


def test_largest_id_stays_whatever_the_ranges(spark):
    rows = [(i, f"text {i % 7}") for i in range(-40, 60)] + [(None, "text 3"), (None, "alone"), (59, "text 3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    for ranges in (1, 3, 8):
        got = exact_duplicates(frame, ranges=ranges).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = next(v for v in want.values() if r["doc_id"] in v and max((i for i in v if i is not None), default=None) == r["keep_id"])
            assert r["group_size"] == len(ids)
        assert sum(r["kept"] for r in got) == len(want)


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a", 5, "x"), (2, "A", 6, "y"), (3, "b", 7, "z")], "doc_id long, text string, __ID long, __sha string")
    kept = drop_duplicates(frame)
    assert kept.columns == frame.columns and sorted(r["__ID"] for r in kept.collect()) == [6, 7]


def test_copies_of_one_row_stay_in_their_tasks(spark):
    """Rows equal in id and text aren't gathered: each comes out of the task that read it, one of them kept."""
    rows = spark.range(40_000, numPartitions=8).select(F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.lit(5)).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    got = exact_duplicates(rows)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 40_000 and len(tasks) > 1 and max(r["count"] for r in tasks) <= 20_000
    assert got.filter("kept").collect() == got.filter("kept and doc_id = 5").collect() and got.filter("kept").count() == 1
    assert got.select("keep_id", "group_size").distinct().collect() == [(5, 40_000)]


def test_nothing_is_left_over(spark, odd):
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")}
    before = tables()
    kept = exact_duplicates(odd).filter("kept").count()
    assert tables() == before and kept > 0
    index = DigestIndex(spark)
    exact_duplicates(odd, index).count()
    assert tables() == before | {index.name}
    index.remove()
    assert tables() == before and not DigestIndex(spark, index.path).exists()
