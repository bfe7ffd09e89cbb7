"""Session factory and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexmill")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing a temporary folder takes its place in a local session (tests); on a cluster it would be
    seen by one machine only, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


class _Scopes(threading.local):
    """Open scopes of this thread, by session: what each has to remove."""

    def __init__(self):
        self.open: dict[str, list[list[tuple[str, str]]]] = {}

    def of(self, spark: SparkSession) -> list[list[tuple[str, str]]]:
        return self.open.setdefault(spark._jsparkSession.sessionUUID(), [])


_scopes = _Scopes()


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard_later(spark: SparkSession, path: str, table: str | None = None, above: int = 0) -> None:
    """Have the scratch() around remove a folder, and a catalog table over it, or that so many scratch() `above` it; without
    one, they stay."""
    held = _scopes.of(spark)
    if len(held) > above:
        held[-1 - above].append((path, table or ""))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this session stages inside on this thread, unless kept, is removed at the end."""
    held = _scopes.of(spark)
    held.append([])
    try:
        yield
    finally:
        for path, table in held.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, path)


#: Has Spark remove a statement's shuffle files at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(frame: DataFrame, name: str, files: int | None = None, keep: bool = False, above: int = 0) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    `files` bounds the number of files of a table known to be small; a kept table outlives every scratch(), and one staged
    `above` outlives so many around it. The shuffle files of the write go at its end: nothing reads them again.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"
    if not keep:
        discard_later(spark, path, above=above)
    with shuffles_removed(spark):
        (frame.coalesce(files) if files else frame).write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
