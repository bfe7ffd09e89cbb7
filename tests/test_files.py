import os
import time

import pytest
from pyspark.sql import functions as F

from lexmill.sources import files
from lexmill.sources.files import NAME, FilesReader, books, dealt, epub_bytes, palm_bytes, register, write_files, written_list


def put(spark, root, rows, mode="append"):
    frame = spark.createDataFrame(rows, "folder string, name string, content binary").repartition(3)
    write_files(frame, str(root), F.col("folder"), F.col("name"), F.col("content"), mode)


@pytest.fixture
def shelf(spark, tmp_path):
    root = tmp_path / "shelf"
    put(spark, root, [
        ("a", "one.epub", epub_bytes("T & U", ["First <page>.", "Second\npage."])), ("a", "two.azw", palm_bytes("Two", "Palm & text " * 900)), ("b/c", "three.txt", b"plain"),
        ("b", "four.txt", "桂枝汤".encode("gb18030")), ("b", "bad.pdf", b"%PDF-1.4 broken"), ("b", "bad.epub", b"PK\x03\x04 broken"), ("", "empty.txt", b""),
    ])
    return root


def load(spark, root, schema=None):
    register(spark)
    reader = spark.read.format(NAME)
    return (reader.schema(schema) if schema else reader).load(str(root))


def test_round_trip(spark, shelf):
    rows = {(r["folder"], r["name"]): r for r in books(load(spark, shelf)).collect()}
    assert len(rows) == 7
    one, two = rows["a", "one.epub"], rows["a", "two.azw"]
    assert (one["format"], one["title"], one["pages"], one["text"]) == ("epub", "T & U", 2, "First <page>.\n\nSecond\npage.")
    assert (two["format"], two["pages"], two["text"]) == ("mobi", 4, "Palm & text " * 900)
    assert rows["b/c", "three.txt"]["text"] == "plain" and rows["b", "four.txt"]["text"] == "桂枝汤" and rows["", "empty.txt"]["text"] == ""
    assert rows["b", "bad.pdf"]["text"] is None and rows["b", "bad.pdf"]["error"] and rows["b", "bad.epub"]["error"]
    assert {(r["folder"], r["name"]): r["size"] for r in written_list(spark, str(shelf)).collect()} == {k: os.path.getsize(next(shelf.glob(f"run-*/{k[0]}/{k[1]}"))) for k in rows}


def test_a_failed_task_leaves_nothing(spark, shelf):
    """A run with a bad row isn't committed, and its files are removed; what was there stays."""
    before, runs = load(spark, shelf).count(), set(os.listdir(shelf))
    with pytest.raises(Exception, match="not a file name"):
        put(spark, shelf, [("x", f"{k}.txt", b"new") for k in range(50)] + [("x", "bad/name", b"")])
    assert set(os.listdir(shelf)) == runs and load(spark, shelf).count() == before


def test_runs(spark, shelf):
    """Appended runs take the place of equal names; an overwriting run takes the place of all."""
    put(spark, shelf, [("b/c", "three.txt", b"changed"), ("new", "x.txt", b"x")])
    rows = {(r["folder"], r["name"]): r["text"] for r in books(load(spark, shelf)).collect()}
    assert len(rows) == 8 and rows["b/c", "three.txt"] == "changed"
    put(spark, shelf, [("only", "y.txt", b"y")], "overwrite")
    assert [r["name"] for r in load(spark, shelf).collect()] == ["y.txt"]


def test_conditions_reach_the_reader(spark, shelf):
    found = load(spark, shelf).filter("format = 'epub' and folder = 'a' and name like 'one%' and size > 5")
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert [r["name"] for r in found.collect()] == ["one.epub"]
    assert "PushedFilters" in plan and "EqualTo(format,epub)" in plan
    assert sorted(r["name"] for r in load(spark, shelf).filter(F.col("suffix").isin(".txt", ".azw")).collect()) == ["empty.txt", "four.txt", "three.txt", "two.azw"]


def test_content_is_read_only_if_asked_for(spark, shelf, monkeypatch):
    rows = load(spark, shelf, "format string, name string").collect()
    assert ("epub", "bad.epub") in {tuple(r) for r in rows} and len(rows) == 7
    fields = spark.createDataFrame([], "format string, name string").schema
    monkeypatch.setattr(files, "READERS", {})
    reader = FilesReader(fields, str(shelf))
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 7


def test_parts_are_bounded():
    parts = dealt((f"/{k}", "", str(k), 1 << 20) for k in range(100))
    assert len(parts) == 4 and max(sum(f[3] for f in p.files) for p in parts) <= files.PART_BYTES
    assert len(dealt((f"/{k}", "", str(k), 1) for k in range(2500))) == 3
    assert len(dealt([("/a", "", "a", 1 << 40), ("/b", "", "b", 1)])) == 2


def test_stream_of_new_files(spark, tmp_path):
    register(spark)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        time.sleep(0.05)
        stream = spark.readStream.format(NAME).load(str(folder))
        query = books(stream).select("name", "text").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start()
        assert query.awaitTermination(60)
        return sorted(tuple(r) for r in spark.read.schema("name string, text string").parquet(out).collect())

    (folder / "a.txt").write_text("one")
    assert run() == [("a.txt", "one")]
    (folder / "b.txt").write_text("two")
    (folder / ".hidden").write_text("no")
    assert run() == [("a.txt", "one"), ("b.txt", "two")]
    assert run() == [("a.txt", "one"), ("b.txt", "two")]


def test_empty_folder(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0 and written_list(spark, str(tmp_path)).count() == 0


def test_committed_files_are_not_listed_by_the_driver(spark, shelf, monkeypatch):
    """Read and removed by the lists of the runs; equal to what the format lists, later runs and files written twice included."""
    put(spark, shelf, [("b/c", "three.txt", b"changed"), ("", "empty.txt", b"no more"), ("b", "_hidden.txt", b"x"), ("b", "z.zip", b"x")])
    put(spark, shelf, [("b", "twice.txt", b"same"), ("b", "twice.txt", b"same")])
    want = {tuple(map(str, r)) for r in load(spark, shelf).collect()}

    def listing(*_):
        raise AssertionError("the driver lists files")

    monkeypatch.setattr(files, "listed", listing)
    got = files.read_committed(spark, str(shelf))
    rows = got.collect()
    assert {tuple(map(str, r)) for r in rows} == want and len(rows) == len(want) == 8
    assert files.current(*files.place(str(shelf)))["files"] == 13
    files.remove_committed(spark, str(shelf))
    assert not shelf.exists()


def test_committed_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, [("a", f"{k}.txt", b"x") for k in range(25)])
    monkeypatch.setattr(files, "PART_FILES", 5)
    assert files.read_committed(spark, str(tmp_path)).rdd.getNumPartitions() == 6
    assert files.read_committed(spark, str(tmp_path)).count() == 25


def test_markup_is_removed_once(spark):
    """One conversion for all formats, below one call of Python."""
    from lexmill.sources.binary import finished

    raw = spark.createDataFrame([("epub", "<p>a &amp; b</p>\f<p> </p>\fc &eacute;", 1, []), ("mobi", "x<mbp:pagebreak/>y &lt;", 1, []), ("txt", "<b>&amp;", 0, [])], "format string, raw string, pages int, notes array<string>")
    done = finished(raw).select("format", "text", "notes")
    assert {tuple(r)[:2] for r in done.collect()} == {("epub", "a & b\n\nc é"), ("mobi", "x\n\ny <"), ("txt", "<b>&amp;")}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") == 1 and plan.count("ArrowEvalPython") == 1


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Only folders pass the driver: two for 60 files, read by as many tasks as shuffles have."""
    from lexmill.sources import knowledge

    for school in ("common", "a b"):
        (tmp_path / school).mkdir()
        for k in range(30):
            (tmp_path / school / f"{k} x.md").write_bytes(b"\xff" * (k % 3))
    (tmp_path / "common" / "_draft.md").write_text("no")
    (tmp_path / "common" / "INDEX.md").write_text("no")
    good, unknown = knowledge.read_documents(spark, str(tmp_path))
    assert good.count() == 30 and good.rdd.getNumPartitions() >= 4
    assert {(r["school"], r["source"]) for r in unknown.collect()} == {("a b", f"{k} x.md") for k in range(30)}
    assert sorted(r["n"] for r in good.selectExpr("octet_length(text) AS n").collect()) == sorted(k % 3 for k in range(30))
    assert [d.count() for d in knowledge.read_documents(spark, str(tmp_path), ["piwei"])] == [0, 30]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


def test_written_documents_are_read_by_their_lists(spark, tmp_path):
    """No scan whose files the driver lists and names; a document written again is read as it was written last."""
    from lexmill.sources import knowledge

    docs = spark.range(40).selectExpr("'en' AS school", "concat('d', id) AS slug", "'T' AS title", "'classic' AS role", "'s' AS source", "concat('text ', id) AS text")
    knowledge.write_documents(docs, str(tmp_path))
    knowledge.write_documents(docs.filter("slug < 'd2'").withColumn("text", F.lit("new")), str(tmp_path))
    rows = knowledge.read_written(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "MapInArrow" in plan
    got = {r["slug"]: r["text"].rpartition("\n")[2] for r in rows.collect()}
    assert got == {f"d{k}": "new" if f"d{k}" < "d2" else f"text {k}" for k in range(40)}
