"""Normalised documents, manifests and ingest state on shared storage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.binary import PIECE_BYTES
from lexmill.sources.files import place, read_committed, write_files

# The domain of schools and the files that aren't documents.
SCHOOLS = ("shanghan", "wenbing", "piwei", "huoshen", "integrative", "nihaixia", "common")
EXCLUDED = ("README.md", "INDEX.md", "MANIFEST.md", "CHANGELOG.md")


#: Names that a task passes on at once.
LISTED = 10_000


def names_in(system, folder: str) -> Iterator[str]:
    """Names of the Markdown files of a folder; on a local file system they come as they are read, never all at once."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            names = (e.name for e in found if e.is_file())
            yield from (n for n in names if n.endswith(".md") and not n.startswith(("_", ".")))
    else:
        names = (i.base_name for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File)
        yield from (n for n in names if n.endswith(".md") and not n.startswith(("_", ".")))


def read_documents(spark: SparkSession, root: str, schools: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(school, source, text) of root/<school>/*.md, and the files whose folder is no known school.

    The driver names the folders only. A task lists a folder, its names are dealt out by a shuffle, and many tasks read the
    files, those of known schools; what comes back to the driver doesn't grow with the files.
    """
    from pyarrow import fs

    system, top = place(root)
    folders = [(i.base_name,) for i in system.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = place(root)
        for batch in batches:
            for school in batch.column(0).to_pylist():
                held = []
                for name in names_in(system, f"{top}/{school}"):
                    held.append(name)
                    if len(held) == LISTED:
                        yield pa.RecordBatch.from_pydict({"school": [school] * LISTED, "source": held})
                        held = []
                if held:
                    yield pa.RecordBatch.from_pydict({"school": [school] * len(held), "source": held})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = place(root)
        made = pa.schema([("school", pa.string()), ("source", pa.string()), ("content", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for school, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_stream(f"{top}/{school}/{name}") as f:
                    rows.append((school, name, f.read()))
                held += len(rows[-1][2])
                if held > PIECE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    def listed(some: list[tuple[str]]) -> DataFrame:
        return spark.createDataFrame(some, "school string").repartition(max(1, len(some)), "school").mapInArrow(names, "school string, source string").filter(~F.col("source").isin(*EXCLUDED))

    good = listed([f for f in folders if f[0] in SCHOOLS and (not schools or f[0] in schools)]).repartition(tasks, "school", "source")
    read = good.mapInArrow(texts, "school string, source string, content binary")
    return read.select("school", "source", F.col("content").cast("string").alias("text")), listed([f for f in folders if f[0] not in SCHOOLS])


def rendered(title: Column, school: Column, role: Column, source: Column, text: Column) -> Column:
    """A document with its front matter."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    head = [F.lit("---"), line("title", title), line("school", school), line("role", role), line("source", source), line("chars", F.length(text).cast("string")), F.lit("---"), F.lit("")]
    return F.concat_ws("\n", *head, text)


def write_documents(docs: DataFrame, root: str) -> None:
    """Markdown with front matter as files <school>/<slug>.md of one committed run, many a task; a document written again
    takes the place of the old, others stay. (school, slug) names a document once."""
    text = rendered(F.col("title"), F.col("school"), F.col("role"), F.col("source"), F.col("text"))
    write_files(docs, root, F.col("school"), F.concat(F.col("slug"), F.lit(".md")), text)


def read_written(spark: SparkSession, root: str) -> DataFrame:
    """(school, slug, text) of what write_documents() wrote."""
    rows = read_committed(spark, root)
    return rows.select(F.col("folder").alias("school"), F.regexp_replace("name", r"\.md$", "").alias("slug"), F.col("raw").alias("text"))


#: Entries of a manifest, by school and slug.
MANIFEST_VERSION = 3
MANIFEST = "version int, school string, slug string, source string, unit string, digest string, role string, title string, chars long"
STATE = "chunker string, space string, source string, fingerprint string, updated timestamp"


def manifest(docs: DataFrame) -> DataFrame:
    """One entry a document of (school, slug, source, unit, digest, role, title, chars)."""
    return docs.select(F.lit(MANIFEST_VERSION).alias("version"), "school", "slug", "source", "unit", "digest", "role", "title", F.col("chars").cast("long").alias("chars"))


def write_manifest(docs: DataFrame, path: str) -> None:
    manifest(docs).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the current version; none where there is no manifest, and without those that can't be read."""
    return read_state(spark, path, MANIFEST).filter(F.col("version") == MANIFEST_VERSION)


def write_state(fingerprints: DataFrame, path: str, chunker: str, space: str, whole: bool = True) -> None:
    """Store (source, fingerprint) rows with the chunker's version, the vector space and the time. A run over some schools
    only (`whole` is false) stores nothing, since it would forget the others."""
    if whole:
        fingerprints.select(F.lit(chunker).alias("chunker"), F.lit(space).alias("space"), "source", "fingerprint", F.current_timestamp().alias("updated")).write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: str = STATE) -> DataFrame:
    """Stored state as JSON lines. A path that isn't there is an empty state; rows that can't be read count as not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.col("_broken").isNull()).drop("_broken")
