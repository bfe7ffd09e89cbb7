"""Books and documents as a Spark data source: a batch and a stream reader, and a writer that commits whole runs."""

from __future__ import annotations

import html
import io
import json
import re
import struct
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexmill.session import remove
from lexmill.sources.binary import PALM_TYPES, PIECE_BYTES, READERS, SKIPPED_NAMES, SKIPPED_SUFFIXES, finished

NAME = "lexmill_files"
#: Bytes and files that one task reads, about.
PART_BYTES, PART_FILES = 32 << 20, 1000
#: First bytes that tell a format.
HEAD = 78
#: What is known without reading a file, from its head, and from its whole content.
SCHEMA = "folder string, name string, suffix string, size bigint, format string, pages int, title string, raw string, notes array<string>, error string"
WHOLE = {"pages", "title", "raw", "notes", "error"}
CURRENT = "_CURRENT.json"


@dataclass
class Some(InputPartition):
    """Files that one task reads: (path, folder, name, size)."""

    files: list[tuple[str, str, str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


def place(path: str):
    """(file system, path within it) of a path or address; the workers open it themselves, so it must be one they share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def current(system, root: str) -> dict | None:
    """What the last commit of a folder says; None where nothing was ever committed."""
    from pyarrow import fs

    if system.get_file_info(f"{root}/{CURRENT}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{root}/{CURRENT}") as f:
        return json.loads(f.read())


def suffix_of(name: str) -> str:
    found = re.search(r"\.[^.]*$", name)
    return found.group().lower() if found else ""


def readable(folder: str, name: str) -> bool:
    hidden = any(p.startswith(("_", ".")) for p in (*folder.split("/"), name))
    return not hidden and name not in SKIPPED_NAMES and suffix_of(name) not in SKIPPED_SUFFIXES


def listed(root: str) -> list[tuple[str, str, str, int, int]]:
    """(path, folder, name, size, time) of the readable files, in order; of a committed folder those of its runs, where a
    later run's file takes the place of an earlier one."""
    from pyarrow import fs

    system, top = place(root)
    done = current(system, top)
    found = {}
    for base in [f"{top}/{run}" for run in done["runs"]] if done else [top]:
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            folder = info.path[len(base) :].strip("/").rpartition("/")[0]
            if info.type == fs.FileType.File and readable(folder, info.base_name):
                found[folder, info.base_name] = (info.path, folder, info.base_name, info.size, info.mtime_ns or 0)
    return [found[k] for k in sorted(found)]


def dealt(files: Iterable[tuple[str, str, str, int]]) -> list[Some]:
    parts: list[Some] = []
    room = count = 0
    for f in files:
        if not parts or f[3] > room or count == PART_FILES:
            parts.append(Some([]))
            room, count = PART_BYTES, 0
        parts[-1].files.append(f)
        room, count = room - f[3], count + 1
    return parts or [Some([])]


def format_of(head: bytes, suffix: str) -> str:
    """Format by the first bytes; the suffix only tells an e-book from another archive."""
    if head[:4] == b"PK\x03\x04":
        return "epub" if suffix == ".epub" else "zip"
    if head[:4] == b"%PDF":
        return "pdf"
    palm = len(head) >= HEAD and head[60:68] in PALM_TYPES and 0 < struct.unpack_from(">H", head, 76)[0] < 65535
    return "mobi" if palm or head[:3] == b"CR!" or head[:8] == b"BOOKMOBI" else "txt"


def keeps(value: str, condition: Filter) -> bool:
    if isinstance(condition, StringStartsWith):
        return value.startswith(condition.value)
    if isinstance(condition, StringEndsWith):
        return value.endswith(condition.value)
    return value in condition.value if isinstance(condition, In) else value == condition.value


class FilesReader(DataSourceReader):
    """Reads files in parts of about PART_BYTES. Conditions on folder, name and suffix leave files unlisted, those on format
    leave them after their first bytes; with a schema that asks for nothing of the content, only these are read."""

    def __init__(self, schema: StructType, root: str):
        self.columns, self.root = [f.name for f in schema.fields], root
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            mine = isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("folder",), ("name",), ("suffix",), ("format",))
            if mine:
                self.conditions.append(f)
            else:
                yield f

    def holds(self, **known: str) -> bool:
        return all(keeps(known[c.attribute[0]], c) for c in self.conditions if c.attribute[0] in known)

    def partitions(self) -> list[Some]:
        return dealt(f[:4] for f in listed(self.root) if self.holds(folder=f[1], name=f[2], suffix=suffix_of(f[2])))

    def read(self, partition: Some) -> Iterator[tuple]:
        system, _ = place(self.root)
        whole = bool(WHOLE & set(self.columns))
        for path, folder, name, size in partition.files:
            suffix = suffix_of(name)
            with system.open_input_stream(path) as f:
                content = f.read(HEAD)
                kind = format_of(content, suffix)
                if not self.holds(format=kind):
                    continue
                content += f.read() if whole else b""
            row = {"folder": folder, "name": name, "suffix": suffix, "size": len(content) if whole else size, "format": kind, "pages": 0, "title": "", "raw": None, "notes": [], "error": None}
            if whole:
                try:
                    raw, pages, notes, *title = READERS[kind](content)
                    row |= {"raw": raw, "pages": pages, "notes": notes, "title": title[0] if title else ""}
                except Exception as error:  # noqa: BLE001 - a broken file is a row with a reason
                    row["error"] = f"{type(error).__name__}: {error}"
            yield tuple(row[c] for c in self.columns)


class FilesStream(DataSourceStreamReader):
    """New files of a folder, by the time they were put there; files come whole and don't change."""

    def __init__(self, schema: StructType, root: str):
        self.reader, self.root = FilesReader(schema, root), root

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        # files of this very moment may still get company of the same time
        before = time.time_ns() - 1_000_000
        return {"until": max((f[4] for f in listed(self.root) if f[4] < before), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        return dealt(f[:4] for f in listed(self.root) if start["until"] < f[4] <= end["until"])

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.reader.read(partition)


class FilesWriter(DataSourceWriter):
    """Writes rows of (folder, name, content) as files of a run of its own, many a task, with a list of them beside each.

    Nothing of a run is seen before its commit, which is one small file put in place of the old; a failed run is removed. A
    task tried again writes the same files over. The driver gets two numbers from each task.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.run = root, overwrite, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = place(self.root)
        base, part = f"{top}/{self.run}", TaskContext.get().partitionId()
        made, files, size = set(), 0, 0
        system.create_dir(f"{base}/_list", recursive=True)
        with system.open_output_stream(f"{base}/_list/part-{part:05}.json") as listing:
            for row in iterator:
                folder, name, content = row["folder"] or "", row["name"], bytes(row["content"] or b"")
                if not name or "/" in name or ".." in folder.split("/"):
                    raise ValueError(f"not a file name: {folder}/{name}")
                if folder not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{folder}/{name}") as f:
                    f.write(content)
                listing.write((json.dumps({"folder": folder, "name": name, "size": len(content)}, ensure_ascii=False) + "\n").encode())
                files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = place(self.root)
        before = current(system, top)
        runs = [] if self.overwrite or before is None else before["runs"]
        held = lambda k: before.get(k, 0) if runs else 0
        now = {"runs": [*runs, self.run], "files": held("files") + sum(m.files for m in messages if m), "bytes": held("bytes") + sum(m.bytes for m in messages if m)}
        with system.open_output_stream(f"{top}/_NEXT-{self.run}") as f:
            f.write(json.dumps(now).encode())
        system.move(f"{top}/_NEXT-{self.run}", f"{top}/{CURRENT}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = place(self.root)
        if system.get_file_info(f"{top}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.run}")


class Files(DataSource):
    """spark.read.format("lexmill_files").load(folder); .writeStream isn't offered."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(schema, self.options["path"])

    def streamReader(self, schema: StructType) -> FilesStream:
        return FilesStream(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, conditions included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Files)


def books(rows: DataFrame) -> DataFrame:
    """(folder, name, format, title, pages, text, notes, error) of rows that the format read: markup turned into text."""
    return finished(rows).select("folder", "name", "format", "title", "pages", "text", "notes", "error")


def write_files(docs: DataFrame, root: str, folder: Column, name: Column, content: Column, mode: str = "append") -> None:
    """One file a row, in one committed run; of rows with one folder and name the last one written stays."""
    register(docs.sparkSession)
    docs.select(folder.alias("folder"), name.alias("name"), content.cast("binary").alias("content")).write.format(NAME).mode(mode).save(root)


def written_list(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, size) of every file of the committed runs, as their tasks listed them."""
    return run_lists(spark, root).select("folder", "name", "size")


def run_lists(spark: SparkSession, root: str) -> DataFrame:
    """written_list() with the `run` of each file."""
    done = current(*place(root)) or {"runs": []}
    schema = "folder string, name string, size long"
    paths = [f"{root}/{run}/_list" for run in done["runs"]]
    if not paths:
        return spark.createDataFrame([], f"{schema}, run string")
    return spark.read.schema(schema).json(paths).select("*", F.regexp_extract("_metadata.file_path", r"/(run-[0-9a-f]+)/_list/", 1).alias("run"))


def parts_of(root: str) -> int:
    """How many tasks take the files of the committed runs, by their number and size."""
    done = current(*place(root)) or {}
    return 1 + max(done.get("files", 0) // PART_FILES, done.get("bytes", 0) // PART_BYTES)


def read_committed(spark: SparkSession, root: str) -> DataFrame:
    """The rows that the format reads from a committed folder, without its conditions: a later run's file takes the place of
    an earlier one.

    What is there is known from the lists of the tasks that wrote it; they are joined and dealt out by a shuffle, so no file
    is listed or named by the driver, however many there are.
    """
    done = current(*place(root)) or {"runs": []}
    place_of = F.array_position(F.lit(done["runs"]), F.col("run")) if done["runs"] else F.lit(0)
    lists = run_lists(spark, root).withColumn("nth", place_of).repartition(parts_of(root), "folder", "name")
    files = lists.groupBy("folder", "name").agg(F.max_by("run", "nth").alias("run"))
    schema = StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, made = FilesReader(schema, root), to_arrow_schema(schema)
        rows, held = [], 0
        _, top = place(root)
        for batch in batches:
            for folder, name, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not readable(folder, name):
                    continue
                for row in reader.read(Some([(f"{top}/{run}/{folder}/{name}", folder, name, -1)])):
                    rows.append(row)
                    held += row[3]
                if held > PIECE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    return files.mapInArrow(run, schema)


def remove_committed(spark: SparkSession, root: str) -> None:
    """Remove a committed folder: its files by many tasks, each those of a part of the lists, then the folders left empty."""
    files = run_lists(spark, root).repartition(parts_of(root)).select("run", "folder", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = place(root)
        gone = 0
        for batch in batches:
            for at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    system.delete_file("/".join((top, *(p for p in at if p))))
                    gone += 1
                except FileNotFoundError:  # written twice, or a task tried again
                    pass
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["files"])

    files.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    remove(spark, root)


def epub_bytes(title: str, pages: list[str]) -> bytes:
    """A plain e-book of the pages, each a text."""
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        put("META-INF/container.xml", '<container><rootfiles><rootfile full-path="book.opf"/></rootfiles></container>')
        ids = [f"page{k}" for k in range(len(pages))]
        items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
        put("book.opf", f"<package><metadata><title>{html.escape(title)}</title></metadata><manifest>{items}</manifest><spine>{''.join(f'<itemref idref="{i}"/>' for i in ids)}</spine></package>")
        for i, text in zip(ids, pages, strict=True):
            put(f"{i}.xhtml", f"<html><body>{html.escape(text)}</body></html>")
    return book.getvalue()


def palm_bytes(title: str, text: str, record: int = 4096) -> bytes:
    """A Palm book of unpacked records."""
    data = html.escape(text).encode()
    records = [data[at : at + record] for at in range(0, len(data), record)]
    head = struct.pack(">HHIHHH", 1, 0, len(data), len(records), record, 0) + b"\0\0MOBI" + struct.pack(">III", 0xE8, 2, 65001) + b"\0" * 0xE0
    starts = [78 + 8 * (len(records) + 1)]
    for r in (head, *records):
        starts.append(starts[-1] + len(r))
    index = b"".join(struct.pack(">II", s, 0) for s in starts[:-1])
    return title.encode()[:31].ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records) + 1) + index + head + b"".join(records)
