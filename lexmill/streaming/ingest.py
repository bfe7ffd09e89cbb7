"""Incremental ingest and event delivery on Structured Streaming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.store import apart, last_of_key
from lexmill.session import stage

#: Column that says which micro-batch a row came with.
BATCH = "batch_id"


def ingest_stream(incoming: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Append each micro-batch's changes to a table of changes, partitioned by batch.

    Of equal keys within a batch the row of highest `order` stays, null counting lowest; ties, and all rows without an
    order, go by the row's digest. A batch overwrites its own partition and no other, so a repeated one changes nothing,
    and what a batch costs depends on its own size. current_rows() is the table as it stands, compact() shortens it.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = last_of_key(batch, key, F.col(order) if order else None).withColumn(BATCH, F.lit(number).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)

    return incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, schema: str, key: str, up_to: int | None = None) -> DataFrame:
    """The last row of each key over all batches, or over those up to one of them; keys are unique within a batch."""
    rows = spark.read.schema(f"{schema}, {BATCH} long").parquet(path)
    rows = rows if up_to is None else rows.filter(F.col(BATCH) <= up_to)
    columns = [c for c in rows.columns if c != BATCH]
    # a null key names no row: such rows replace each other only where they are equal
    return rows.groupBy(key, apart(rows.select(*columns), [key]).alias("__apart")).agg(F.max_by(F.struct(*columns), BATCH).alias("last")).select("last.*")


def compact(spark: SparkSession, path: str, target: str, schema: str, key: str, up_to: int) -> None:
    """Write the table as it stood after batch `up_to`, as that batch's partition of a new table; later batches go on there."""
    current_rows(spark, path, schema, key, up_to).withColumn(BATCH, F.lit(up_to).cast("long")).write.partitionBy(BATCH).parquet(target)


def frame(event: Column, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def unframe(buffer: Column) -> Column:
    """Array of (event, data) of the complete frames in a buffer."""
    parts = F.split(buffer, "\n\n")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda f: F.struct(F.regexp_extract(f, r"event: ([^\n]*)", 1).alias("event"), F.regexp_extract(f, r"data: ([^\n]*)", 1).alias("data")))


BREAK = "\n\n"
#: A prefix after which frames can be told without what came before: up to the first break behind a character that is no
#: line feed, since a run of line feeds is cut in pairs from where it begins.
SYNC = re.compile(r"\n*[^\n].*?\n\n", re.S)


class _Cut:
    """Frames of one stream's text as it comes in; what is open is joined only when a break may have come."""

    def __init__(self, begun: bool):
        self.held: list[str] = []
        self.last = ""
        self.head: str | None = "" if begun else None  # None until a place is found from which frames can be told

    def take(self, text: str) -> list[str]:
        if not text:
            return []
        broken = BREAK in self.last + text
        self.last = text[-1]
        self.held.append(text)
        if not broken:
            return []
        whole = "".join(self.held)
        if self.head is None:
            found = SYNC.match(whole)
            if found is None:
                self.held = [whole]
                return []
            self.head, whole = whole[: found.end()], whole[found.end() :]
        *frames, rest = whole.split(BREAK)
        self.held = [rest]
        return frames

    def open(self) -> str:
        return "".join(self.held)


def _scan_buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted part of the buffers: its frames, and what is open at its edges. Only the first stream of a part can have
    begun before, and only the last can go on."""
    part, number, stream, cut, seq = TaskContext.get().partitionId(), 0, None, None, 0
    schema = None
    for batch in in_rows(batches):
        schema = schema or pa.schema([("part", pa.int32()), batch.schema.field(0).with_name("stream"), ("seq", pa.int64()), ("frame", pa.string()), ("head", pa.string()), ("tail", pa.string())])
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if cut is None or key != stream:
                if cut is not None and number == 1:
                    out.append((part, stream, -1, None, *_edges(cut)))
                stream, cut, seq, number = key, _Cut(number > 0), 0, number + 1
            for frame in cut.take(text or ""):
                out.append((part, stream, seq, frame, None, None))
                seq += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if cut is not None:
        last = [(part, stream, -1, None, *_edges(cut))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last, strict=True), schema, strict=True)], schema=schema)


def _edges(cut: _Cut) -> tuple[str, str | None]:
    """What of a part belongs to the frame before, and what stays open; with no place to begin from, all is the former."""
    return (cut.open(), None) if cut.head is None else (cut.head, cut.open())


def in_rows(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames that go over the edges of parts, from the edges in order."""
    stream, carry, any_yet = None, [], False
    for batch in in_rows(batches):
        out = []
        for part, key, head, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not any_yet or key != stream:
                stream, carry, any_yet = key, [], True
            carry.append(head)
            if tail is not None or BREAK in "".join(carry[-2:])[-len(head) - 1 :]:
                *frames, rest = "".join(carry).split(BREAK)
                out += [(part, key, k, f) for k, f in enumerate(frames)]
                carry = [rest if tail is None else tail]
        if out:
            columns = zip(zip(*out, strict=True), (pa.int32(), batch.schema.field(1).type, pa.int64(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["part", "stream", "seq", "frame"])


def reassembled(buffers: DataFrame, group: str, order: str, text: str, parts: int | None = None) -> DataFrame:
    """(group, event_no, event, data): the frames of partial buffers, each buffer's tail carried over to the next.

    A parallel scan: buffers are dealt out by ranges of (group, order), so one stream of any length falls to many tasks.
    Each task cuts the frames that it can tell alone and reports what is open at its edges, two rows at most; the edges,
    in order, give the frames that go from one task's part into the next. Frames are numbered by the counts of the parts
    before. What follows the last frame of a stream stays out; null buffers count as empty; `order` is unique in a group.
    """
    kind = buffers.schema[group].dataType.simpleString()
    by = [parts] if parts else []
    placed = buffers.select(F.col(group), F.col(order), F.col(text)).repartitionByRange(*by, group, order).sortWithinPartitions(group, order).select(group, text)
    scanned = stage(placed.mapInArrow(_scan_buffers, f"part int, stream {kind}, seq long, frame string, head string, tail string"), "frames")
    # two rows a part at most
    edges = scanned.filter("seq < 0").select("part", "stream", "head", "tail").coalesce(1).sortWithinPartitions("part", "stream")
    crossing = stage(edges.mapInArrow(_stitch, f"part int, stream {kind}, seq long, frame string"), "crossing")
    own = scanned.filter("seq >= 0").select("part", "stream", "seq", "frame")
    both = crossing.select("*", F.lit(0).alias("late")).unionByName(own.withColumn("late", F.lit(1)))
    before = Window.partitionBy("stream").orderBy("part", "late").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy("stream", "part", "late").count().select("stream", "part", "late", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    same = F.col("a.stream").eqNullSafe(F.col("b.stream")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.late") == F.col("b.late"))
    numbered = both.alias("a").join(starts.alias("b"), same).select(F.col("a.stream").alias(group), (F.col("start") + F.col("seq")).cast("int").alias("event_no"), "frame")
    pick = lambda name: F.regexp_extract("frame", f"{name}: ([^\\n]*)", 1).alias(name)
    return numbered.select(group, "event_no", pick("event"), pick("data"))


def report_events(sessions: DataFrame) -> DataFrame:
    """(session_id, seq, event): the order in which a report is told; `flags`, `agents` and `failed` come with a session."""
    one = lambda name: F.array(F.lit(name))
    risk = F.when(F.size("flags") > 0, one("risk_detected")).otherwise(F.array().cast("array<string>"))
    told = F.concat(one("stage_started"), risk, one("stage_started"), F.array_repeat(F.lit("agent_result"), F.col("agents")))
    ended = F.when(F.col("failed"), one("error")).otherwise(F.array(*(F.lit(x) for x in ("stage_started", "report", "completed"))))
    return sessions.select("session_id", F.posexplode(F.concat(told, ended)).alias("seq", "event"))


def session_events(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the report events of each finished session, as they come, to a table partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        told = report_events(batch).withColumn(BATCH, F.lit(number).cast("long"))
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consultation_events(sessions: DataFrame) -> DataFrame:
    """(session_id, seq, event) of sessions with `flags`: a risky one is told so and ends, any other goes on to its facts."""
    listed = lambda *names: F.array(*(F.lit(n) for n in names))
    told = F.when(F.size("flags") > 0, listed("stage_started", "risk_detected", "completed")).otherwise(listed("stage_started", "fact_proposed", "agent_message", "completed"))
    return sessions.select("session_id", F.posexplode(told).alias("seq", "event"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by type and hour; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
