"""Incremental ingest as a stateful stream: what each source last looked like is kept in the stream's own state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the sources are dealt into by their hash; a checkpoint holds for one number of them.
BUCKETS = 1024
#: Columns that tell a row's group and its source within.
BUCKET, NAME = "__bucket", "__name"
KNOWN = "names array<string>, fingerprints array<string>, until array<bigint>"


class LastSeen(StatefulProcessor):
    """Lets rows of a source pass only if its fingerprint differs from the last one, with `new` or `changed`.

    The state is that of a group of sources: it is read and written once for all of them that a micro-batch brings, since
    each call of a state goes to the JVM and back. A source's rows of one micro-batch are taken in the order of `order`, then
    of the fingerprint; only the last of them passes, as the others are out of date. A source that isn't seen for `keep_ms`
    of event time is forgotten by its group's timer, which stands at the earliest such time; each sighting moves a source's
    time on, whether the source changed or not. It counts as new when it comes back.
    """

    def __init__(self, columns: list[str], fingerprint: str, order: str | None, seen_at: str | None, keep_ms: int | None):
        self.columns, self.fingerprint, self.order, self.seen_at, self.keep_ms = columns, fingerprint, order, seen_at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("known", KNOWN)

    def known(self) -> dict[str, tuple[str, int]]:
        """(fingerprint, time until which it is kept) by source."""
        held = self.state.get()
        return {n: (f, u) for n, f, u in zip(*held, strict=True)} if held else {}

    def keep(self, known: dict[str, tuple[str, int]]) -> None:
        if not known:
            return self.state.clear()
        self.state.update((list(known), [f for f, _ in known.values()], [u for _, u in known.values()]))

    def rank(self, row: Row) -> tuple:
        """What rows of one source go by; null and not-a-number come first."""
        values = [row[c] for c in (self.order, self.fingerprint) if c]
        return tuple((x is not None and x == x, x if x is not None and x == x else 0) for x in values)

    def seen(self, row: Row) -> int:
        at = row[self.seen_at]
        return 0 if at is None else int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last: dict[str, tuple[tuple, Row]] = {}
        latest: dict[str, int] = {}
        for row in rows:
            name, rank = row[NAME], self.rank(row)
            if name not in last or rank >= last[name][0]:
                last[name] = rank, row
            if self.seen_at:
                latest[name] = max(latest.get(name, 0), self.seen(row))
        known, made, out = self.known(), Row(*self.columns, "status"), []
        for name, (_, row) in last.items():
            before, until = known.get(name, (None, 0))
            if self.keep_ms is not None:
                until = max(latest[name] + self.keep_ms, until, timerValues.getCurrentWatermarkInMs() + 1)
            now = row[self.fingerprint]
            known[name] = now, until
            if before is None or before != now:
                out.append(made(*(row[c] for c in self.columns), "new" if before is None else "changed"))
        if out or self.keep_ms is not None:
            self.keep(known)
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(min(u for _, u in known.values()), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        past = timerValues.getCurrentWatermarkInMs()
        known = {n: x for n, x in self.known().items() if x[1] > past}
        self.keep(known)
        if known:
            self.handle.registerTimer(min(u for _, u in known.values()))
        return iter(())

    def close(self) -> None:
        pass


def changes(
    incoming: DataFrame, key: str, fingerprint: str = "fingerprint", order: str | None = None, seen_at: str | None = None, keep_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The stream's rows whose source is new or changed, with a `status`; unchanged sources are dropped within the stream.

    With `keep_ms`, `seen_at` names the stream's timestamp under its watermark; sources go by that time. The fingerprints are
    state of the tasks that the sources hash to, in `buckets` groups: a micro-batch touches the groups of the sources it
    brings, and nothing is joined with a table of all sources. Take about a thousand sources a group where micro-batches are
    large, fewer where they are small. Fingerprints must not be null.
    """
    processor = LastSeen(incoming.columns, fingerprint, order, seen_at, keep_ms)
    schema = StructType([*incoming.schema.fields, StructField("status", StringType())])
    name = F.to_json(F.struct(F.col(f"`{key}`")))
    named = incoming.withColumn(NAME, name).withColumn(BUCKET, F.pmod(F.xxhash64(NAME), F.lit(buckets)))
    return named.groupBy(BUCKET).transformWithState(processor, schema, "Update", "none" if keep_ms is None else "eventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def write_changes(incoming: DataFrame, key: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the changed rows of each micro-batch to a table partitioned by batch; a batch done again overwrites itself.

    State, offsets and results go on from the checkpoint after a restart.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    with rocksdb_state(incoming.sparkSession):
        return changes(incoming, key, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
