"""Operator 4: exact deduplication against a persistent digest index."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, free_name, join_groups
from lexmill.session import remove, shared_dir, stage

#: Buckets of a new index at least, and digests that one bucket of it has about.
BUCKETS, PER_BUCKET = 16, 1 << 20
#: Id ranges that a table is taken in by, the largest ids first.
RANGES = 2
#: Stands for a missing id in a join.
NO_ID = -(1 << 63)

COLUMNS = "digest STRING, keep_id BIGINT, copies BIGINT, first BOOLEAN, batch STRING"


class DigestIndex:
    """A folder of Parquet files, bucketed and sorted by digest, that grows batch by batch and outlives the session.

    The folder is the index: whether it exists, and in how many buckets, is read from the path. The catalog only says how
    the files are bucketed; in a session that doesn't know the table yet it is registered again over the same files, so
    nothing is ever written over them. The first row of a digest (`first`) holds the id that stays for it and the copies
    that its batch had; other rows only count further copies. What is already in the index wins. A batch that is given
    again, after a failure or by mistake, is found by its name and not added again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """`buckets` is for a new index; if it is left out, the first table that is taken in decides."""
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/lexmill/digests-{uuid.uuid4().hex}").rstrip("/")
        self.name = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        held = self._folders()
        self.buckets = int(held[0].removeprefix("buckets-")) if held else buckets

    def open(self, rows: int) -> None:
        """Settle the number of buckets of a new index whose first table has so many rows."""
        self.buckets = self.buckets or max(BUCKETS, 1 << (rows // PER_BUCKET).bit_length())

    def _folders(self) -> list[str]:
        """Folders of the index that hold files of finished batches."""
        java = self.spark._jvm.org.apache.hadoop.fs
        root = java.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        named = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("buckets-")]
        return sorted(p.getName() for p in named if any(f.getPath().getName().startswith("part-") for f in files.listStatus(p)))

    def exists(self) -> bool:
        return bool(self._folders())

    def table(self) -> DataFrame:
        """All rows of the index; the table is registered where the session's catalog doesn't have it."""
        self.open(0)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/buckets-{self.buckets}'"
        )
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def held(self, names: list[str]) -> set[str]:
        """Those of the named batches that are in the index."""
        return {r["batch"] for r in self.table().filter(F.col("batch").isin(names)).select("batch").distinct().collect()}

    def remove(self) -> None:
        """Drop the table and delete the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def read(self, own: list[str] | None = None, new: list[str] | None = None) -> DataFrame:
        """(digest, keep_id, copies, mine, fresh): one row a digest, its rows in all batches counted, without a shuffle; mine
        counts those of the `own` batches, fresh tells whether its first row came with a `new` one."""
        return self.table().groupBy("digest").agg(
            F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"), F.sum("copies").alias("copies"),
            F.sum(F.when(F.col("batch").isin(own or []), F.col("copies")).otherwise(0)).alias("mine"), F.max(F.col("first") & F.col("batch").isin(new or [])).alias("fresh"),
        )

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of a batch's groups (digest, keep_id, copies) that the index doesn't hold.

        The sort-merge anti-join reads the index bucket by bucket and leaves the rows bucketed like it, so they are written
        without another shuffle, one sorted file a bucket. Files of a job that fails are not seen by readers.
        """
        held = self.table().filter("first").select("digest").hint("merge")
        self._write(groups.join(held, "digest", "left_anti").withColumn("first", F.lit(True)), batch)

    def count(self, groups: DataFrame, batch: str) -> None:
        """Add further copies (digest, copies) of digests that the index holds."""
        self._write(groups.withColumns({"keep_id": F.lit(None).cast("long"), "first": F.lit(False)}), batch)

    def _write(self, rows: DataFrame, batch: str) -> None:
        named = rows.select("digest", "keep_id", "copies", "first", F.lit(batch).alias("batch"))
        named.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, place): SHA-256 of the text with A-Z lower-cased, one row a document; places differ once written."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("place"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, ranges: int = RANGES, resume: bool = False) -> DataFrame:
    """Group, surviving row and verdict for each document; the index takes in the new digests.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty. The documents go into the index in
    `ranges` batches by id, the largest ids first and null ids last, so of equal new texts the row with the largest
    doc_id stays: each batch drops what the index holds already. A digest that the index held before the call keeps its
    old row, so all its new rows are dropped. Of rows with the same id and the same text one is kept. A null id stays
    only where all of its group are null. A group's size counts its rows in this and in all earlier batches of the index;
    the same rows given twice count once. Empty table: no rows. Other columns of the input are not read.

    Rows that are given again are held by the index, so all are dropped; with `resume` they get the verdicts of the call
    before, which may have failed at any point.

    A group of any size is a count and a maximum, summed before the shuffle; the largest groups, by the call's own
    counts, are joined back by broadcast (fewer than 1000 by their definition), the others by sort-merge. Rows that are
    equal in id and text stay in the tasks that read them; of all rows of a group the one with the largest id and then
    the first place is the one that may stay. Without an index the call has one of its own, which is removed at its end.
    """
    own_index = index is None
    index = index or DigestIndex(docs.sparkSession)
    rows = stage(digest_rows(docs), "digests")
    # a call's name: the number of its rows and two sums of hashes of them, whatever their order
    marks = (F.sum(F.xxhash64(F.lit(k), "doc_id", "digest").cast("decimal(20,0)")) for k in range(2))
    low, high, total, *marks = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), *marks).first()
    low, high = (0, 0) if low is None else (low, high)
    name = "-".join(str(x or 0) for x in (total, *marks))
    width = -(-(high - low + 1) // max(1, ranges))
    starts = [*range(low, high + 1, width)][::-1]
    index.open(total)
    names, counts = [f"{name}-{k}" for k in range(len(starts))], f"{name}-counts"
    held = index.held([*names, counts])
    taken = []
    for k, start in enumerate(starts):
        batch = names[k]
        inside = F.col("doc_id") >= start
        inside = inside & (F.col("doc_id") < start + width) if k else inside
        some = rows.filter(inside if k < len(starts) - 1 else inside | F.col("doc_id").isNull())
        if batch not in held:
            index.append(some.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies")), batch)
        if batch not in held or resume:
            taken.append(batch)
    last = F.struct("doc_id", (-F.col("place")).alias("place"))
    own = rows.groupBy("digest").agg(F.count("*").alias("own"), F.max(last)["place"].alias("first"))
    known = index.read([*names, counts], taken)
    pairs = own.join(known.hint("merge"), "digest").withColumn("group_size", F.col("copies") - F.col("mine") + F.col("own"))
    merged = stage(pairs, "groups")
    if counts not in held:
        # from the join itself, whose rows lie like the index
        index.count(pairs.filter("own > mine").select("digest", (F.col("own") - F.col("mine")).alias("copies")), counts)
    if own_index:
        index.remove()
    found = join_groups(rows, merged.select("digest", "keep_id", "own", "first", "group_size", "fresh"), "digest", "own", total)
    first = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("place") == -F.col("first")) & F.col("fresh")
    return found.select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that exact_duplicates() keeps, with all their columns, whatever their names.

    Each kept (doc_id, digest) meets its row by a join on both; rows repeated with the same id and text are cut to one.
    The one shuffle of the texts, by these two, serves the join and the cut, and no hot text falls to one task.
    """
    id_, sha = free_name(docs, "id"), free_name(docs, "sha")
    known = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias(id_)
    kept = exact_duplicates(docs.select("doc_id", "text"), index).filter("kept").select(known, F.col("text_sha256").alias(sha))
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.select("*", known, F.sha2(text.cast("binary"), 256).alias(sha))
    return marked.join(kept, [id_, sha], "left_semi").dropDuplicates([id_, sha]).drop(id_, sha)
