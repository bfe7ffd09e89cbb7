"""Cleaning by segments against the fold over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import longtext
from lexmill.operators.corpus import drop_noise, join_broken_lines, normalise

LINES = (
    "", "", "目录...... 3", "上篇 . . . . 12", "第一章  7", "阴阳应象  9", "扫码关注公众号", "- 12 -", "----", "# 卷一", "一、总论", "夫百病之生也", "皆生于风寒暑湿燥火，", "以之化之变也。", "「经言」", "短",
    "盛者泻之，虚则补之，余锡以方士，而方士用之，尚未能十全，余欲令要道必行，桴鼓相应，犹拔刺雪污，工巧神圣，可得闻乎，岐伯曰，审察病机，无失气宜，此之谓也，愿闻病机何如，岐伯曰诸风掉眩皆属于肝",
    "长" * 610, "句" * 590 + "。", "x of Latin words", "ends here.", "（注）",
)


def texts(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        some = draw.sample(LINES, draw.randint(2, 8)) if draw.random() < 0.7 else LINES
        yield draw.choice(["\n", "\r\n"]).join(draw.choice(some) for _ in range(draw.randint(1, 120)))


@pytest.fixture(scope="module")
def docs(spark):
    given = [*texts(3, 150), None, "", "\n\n\n", "  \n ", "目录...... 3\n" * 450 + "第一章  7\n" * 9 + "正文。", "无止境的文字" * 3 + "\n", "字词句读之不知\n" * 300]
    return spark.createDataFrame(list(enumerate(given)), "seg long, lines string").repartition(4).cache()


@pytest.mark.parametrize("per", [1, 3, 7, 50, 2048])
def test_equals_whole_fold(docs, per):
    got = {r[0]: r[1] for r in longtext.normalised(docs, "seg", "lines", per=per).collect()}
    want = {r[0]: r[1] for r in docs.select("seg", normalise(F.col("lines"))).collect()}
    assert got == want


def test_steps_equal_folds(docs):
    """Noise and paragraphs alone, before the later steps could hide a difference."""
    cut = longtext.cut_lines(docs, "seg", "lines", per=5).cache()
    whole = cut.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", "lines"))), lambda x: x["lines"])).alias("lines"))
    kept = longtext.without_noise(cut).cache()
    flat = lambda f, order, items: {r[0]: r[1] for r in f.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, items))), lambda x: x[items]))).collect()}
    less = drop_noise(F.col("lines"))
    noise = {r[0]: r[1] for r in whole.select("key", less).collect() if r[1]}
    assert flat(kept, "seg", "lines") == noise
    joined = {r[0]: r[1] for r in whole.select("key", join_broken_lines(less)).collect() if r[1]}
    assert {k: v for k, v in flat(longtext.paragraphs(kept), "stretch", "items").items() if v} == joined


def test_long_text_over_many_tasks(spark):
    """A text of 100,000 lines is cut into rows of many partitions, none with more than a few segments' lines."""
    text = "\n".join(f"第{i}句说的是这一件事情而且说得相当详细。" if i % 7 else "" for i in range(100_000))
    one = spark.createDataFrame([(1, text)], "id long, text string")
    cut = longtext.cut_lines(one, "id", "text").withColumn("part", F.spark_partition_id())
    assert cut.select("part").distinct().count() > 1
    assert cut.agg(F.max(F.size("lines"))).first()[0] == longtext.SEGMENT
    joined = longtext.paragraphs(longtext.without_noise(cut.drop("part")))
    assert joined.count() > 40
    assert longtext.clean_blocks(one, "id", "text").count() == 100_000 // 7 + 1


def test_repeated_and_null_keys(spark):
    rows = [(1, "一句话。\n\n另一句"), (1, "一句话。\n\n另一句"), (1, "别的"), (None, "别的"), (None, None)]
    frame = spark.createDataFrame(rows, "key long, text string")
    got = sorted(longtext.normalised(frame, "key", "text").collect(), key=str)
    assert got == sorted(frame.select("key", normalise(F.col("text")).alias("text")).collect(), key=str)


def test_no_documents(spark):
    assert longtext.normalised(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_short_texts_stay_where_they_are(spark, monkeypatch):
    """Only texts of more than one segment are cut, staged and shuffled."""
    cut, whole = [], longtext.clean_blocks
    monkeypatch.setattr(longtext, "clean_blocks", lambda docs, *a: cut.append(docs.count()) or whole(docs, *a))
    rows = [(1, "a\nb"), (2, "\r".join("abcdefg")), (3, None), (4, "a\nb\nc")]
    frame = spark.createDataFrame(rows, "id long, text string")
    got = sorted(map(tuple, longtext.normalised(frame, "id", "text", per=3).collect()))
    assert cut == [1]
    assert got == sorted((i, t or "") for i, t in frame.select("id", normalise(F.col("text"))).collect())
