import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators.evaluation import self_check
from lexmill.operators.store import last_of_key, upsert
from lexmill.streaming.ingest import current_rows, reassembled

SCHEMA = "stream string, n long, t string"


def slow(buffers):
    out = []
    for stream in {s for s, _, _ in buffers}:
        whole = "".join(t or "" for s, _, t in sorted((b for b in buffers if b[0] == stream), key=lambda b: b[1]))
        for k, f in enumerate(whole.split("\n\n")[:-1]):
            pick = lambda name, f=f: (re.search(rf"{name}: ([^\n]*)", f) or [None, ""])[1]
            out.append((stream, k, pick("event"), pick("data")))
    return out


def cut(stream, text, rng):
    at, n, out = 0, 0, []
    while at < len(text):
        size = rng.choice([0, 1, 1, 2, 5, 40])
        out.append((stream, n, text[at : at + size] if size or n % 2 else None))
        at, n = at + size, n + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_frames_across_many_tasks(spark, seed):
    """Streams of any length, cut anywhere, with runs of line feeds and frames longer than a task's part."""
    rng = random.Random(seed)
    buffers = []
    for stream, frames in (("a", 120), ("b", 1), (None, 30), ("c", 0), ("d", 40)):
        pieces = [rng.choice(["event: e\ndata: {}".format(k), "\n", "", "\n\n\n", f"data: x{k}\nevent: late", "y" * rng.choice([1, 3, 600]), "event: "]) + "\n\n" * (rng.random() < 0.8) for k in range(frames)]
        buffers += cut(stream, "".join(pieces) + "event: open", rng)
    rng.shuffle(buffers)
    frame = spark.createDataFrame(buffers, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = [tuple(r) for r in reassembled(frame, "stream", "n", "t", parts=9).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got, key=str) == sorted(slow(buffers), key=str)


def test_one_stream_falls_to_several_tasks(spark):
    rows = spark.range(3000).select(F.lit("s").alias("stream"), F.col("id").alias("n"), F.concat(F.lit("event: e\ndata: "), F.col("id"), F.lit("\n\n")).alias("t"))
    got = reassembled(rows, "stream", "n", "t", parts=6)
    assert [tuple(r) for r in got.orderBy("event_no").collect()] == [("s", k, "e", str(k)) for k in range(3000)]
    assert reassembled(rows.limit(0), "stream", "n", "t").count() == 0


def test_rows_with_null_keys_are_kept(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v string")
    incoming = frame((None, "x"), (None, "y"), (None, "y"), ("a", "1"), ("a", "1"))
    assert sorted(map(str, last_of_key(incoming, "k").collect())) == sorted(map(str, frame((None, "x"), (None, "y"), ("a", "1")).collect()))
    once = upsert(frame(("a", "0"), ("b", "0"), (None, "z")), incoming, "k")
    twice = upsert(once, incoming, "k")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) == sorted(map(str, frame((None, "x"), (None, "y"), (None, "z"), ("a", "1"), ("b", "0")).collect()))
    path = str(tmp_path / "changes")
    incoming.distinct().withColumn("batch_id", F.lit(3).cast("long")).write.partitionBy("batch_id").parquet(path)
    assert current_rows(spark, path, "k string, v string", "k").count() == 3


def test_a_query_that_misses_itself_failed(spark):
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.4), (3, 3, 0.2)], "query_id long, passage_id long, score double")
    assert self_check(scores).first()["top1"] == pytest.approx(2 / 3)
