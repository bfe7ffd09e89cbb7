from pyspark.sql import functions as F

from lexmill.streaming.changes import changes, rocksdb_state, write_changes

SCHEMA = "source string, fingerprint string, n long"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, out, checkpoint, **options):
    """One run to the end of what is there, as a new query on the same checkpoint; what it let pass."""
    before = {tuple(r) for r in read(spark, out)}
    query = write_changes(spark.readStream.schema(SCHEMA).parquet(str(folder)), "source", str(out), str(checkpoint), order="n", **options)
    assert query.awaitTermination(60)
    assert query.exception() is None
    return {(r["source"], r["fingerprint"], r["status"]) for r in read(spark, out) if tuple(r) not in before}


def read(spark, out):
    return spark.read.schema(f"{SCHEMA}, status string, batch_id int").parquet(str(out)).collect() if out.exists() else []


def test_unchanged_sources_stop_in_the_stream(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    put(spark, folder, [("a", "1", 1), ("b", "1", 1), ("b", "2", 2), ("c", "1", 1)])
    assert run(spark, folder, out, checkpoint) == {("a", "1", "new"), ("b", "2", "new"), ("c", "1", "new")}
    # after a restart the state is there
    put(spark, folder, [("a", "1", 5), ("b", "3", 5), ("d", "9", 5)])
    assert run(spark, folder, out, checkpoint) == {("b", "3", "changed"), ("d", "9", "new")}
    put(spark, folder, [("a", "1", 7), ("b", "3", 7), ("d", "9", 7), ("c", "1", 1)])
    assert run(spark, folder, out, checkpoint) == set()
    put(spark, folder, [("b", "1", 9)])
    assert run(spark, folder, out, checkpoint) == {("b", "1", "changed")}


def test_sources_are_forgotten_by_timer(spark, tmp_path):
    """Event time moves on with other sources; what wasn't seen for a minute of it is new again, what was seen isn't."""
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"

    def step(rows):
        put(spark, folder, rows)
        before = read(spark, out)
        timed = spark.readStream.schema(SCHEMA).parquet(str(folder)).withColumn("at", F.timestamp_seconds("n")).withWatermark("at", "1 second")
        query = write_changes(timed, "source", str(out), str(checkpoint), order="n", seen_at="at", keep_ms=60_000)
        assert query.awaitTermination(60)
        held = {(r["batch_id"], r["source"]) for r in before}
        return {(r["source"], r["status"]) for r in read(spark, out) if (r["batch_id"], r["source"]) not in held}

    assert step([("a", "1", 1000), ("b", "1", 1000)]) == {("a", "new"), ("b", "new")}
    assert step([("b", "1", 1050)]) == set()
    assert step([("x", "1", 1090)]) == {("x", "new")}
    assert step([("a", "1", 1095), ("b", "1", 1095)]) == {("a", "new")}


def test_plan_has_no_join(spark, tmp_path):
    folder = tmp_path / "in"
    put(spark, folder, [("a", "1", 1)])
    with rocksdb_state(spark):
        out = changes(spark.readStream.schema(SCHEMA).parquet(str(folder)), "source")
    assert out.columns == ["source", "fingerprint", "n", "status"]
    assert "Join" not in out._jdf.queryExecution().logical().toString()


def test_many_sources_share_a_group(spark, tmp_path):
    """The state is called once a group, not once a source; large numbers, nulls and late rows come through as they are."""
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    big = 2**53 + 1
    put(spark, folder, [(f"s{k}", "1", big + k) for k in range(300)] + [(None, "1", None), ("s7", "0", None)])
    first = run(spark, folder, out, checkpoint, buckets=2)
    assert first == {(f"s{k}", "1", "new") for k in range(300)} | {(None, "1", "new")}
    assert {r["n"] for r in read(spark, out)} == {big + k for k in range(300)} | {None}
    put(spark, folder, [(f"s{k}", str(k % 2), 0) for k in range(300)] + [(None, "2", 1), ("new", "1", 1)])
    assert run(spark, folder, out, checkpoint, buckets=2) == {(f"s{k}", "0", "changed") for k in range(0, 300, 2)} | {(None, "2", "changed"), ("new", "1", "new")}
    plan = changes(spark.readStream.schema(SCHEMA).parquet(str(folder)), "source")._jdf.queryExecution().logical().toString()
    assert "__bucket" in plan


def test_sources_of_one_group_are_forgotten_apart(spark, tmp_path):
    """One timer a group: at its time only those go that weren't seen since, and it stands anew at the next one's time."""
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"

    def step(rows):
        put(spark, folder, rows)
        before = {(r["batch_id"], r["source"]) for r in read(spark, out)}
        timed = spark.readStream.schema(SCHEMA).parquet(str(folder)).withColumn("at", F.timestamp_seconds("n")).withWatermark("at", "1 second")
        query = write_changes(timed, "source", str(out), str(checkpoint), order="n", seen_at="at", keep_ms=60_000, buckets=1)
        assert query.awaitTermination(60)
        return {(r["source"], r["status"]) for r in read(spark, out) if (r["batch_id"], r["source"]) not in before}

    assert step([("a", "1", 1000), ("b", "1", 1000), ("c", "1", 1000)]) == {("a", "new"), ("b", "new"), ("c", "new")}
    assert step([("b", "1", 1030), ("c", "1", 1050)]) == set()
    assert step([("x", "1", 1085)]) == {("x", "new")}
    assert step([("a", "1", 1086), ("b", "1", 1086)]) == {("a", "new")}
    assert step([("x", "1", 1125)]) == set()
    assert step([("c", "1", 1126), ("b", "1", 1126)]) == {("c", "new")}
