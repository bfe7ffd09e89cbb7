"""Cleaning of very long texts by many tasks: the folds of `normalise` as scans over segments of a text's lines.

A text is cut into segments of lines. What a fold carries from one segment into the next is a small state, so each segment
first tells what it makes of every state (a function of few values), the functions are applied in order, one short row a
segment, and then each segment is folded on its own from the state it begins with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import HAN, let, squeeze_blank_lines, unify_lines, unify_punctuation
from lexmill.operators.corpus import (
    CONTENTS_START, LONG_LINE, REPEAT_CHARS, SENTENCE_ENDS, drop_front, drop_noise, join_broken_lines, noise_marks, normalise, run_after, stands_alone,
)
from lexmill.session import stage

#: Lines of a segment.
SEGMENT = 2048


def tasks(frame: DataFrame) -> int:
    """Partitions of segments. Stated, since few bytes of lines are much work, and adaptive plans merge partitions by bytes."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_lines(docs: DataFrame, key: str, text: str, script: str = HAN, per: int = SEGMENT) -> DataFrame:
    """(key, seg, lines): the lines of each text behind its front, in segments that are dealt out to all tasks."""
    lines = drop_front(F.split(unify_lines(F.col(text)), "\n"), script)
    parts = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(per)), lambda i: F.slice(all_, i + 1, F.lit(per)))
    cut = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(let(lines, parts)).alias("seg", "lines"))
    return cut.repartition(tasks(docs), "key", "seg")


def exits(lines: Column) -> Column:
    """What a segment makes of the run of contents lines it begins with: the run behind it for each of 0 to CONTENTS_START,
    and whether a line of text ends a run. From CONTENTS_START on lines count alike, so a longer run that isn't ended
    grows by as much as one of CONTENTS_START."""
    runs = range(CONTENTS_START + 1)
    name = lambda r: f"r{r}"

    def step(acc: Column, item: Column) -> Column:
        after = [run_after(item, acc[name(r)]) for r in runs]
        return F.struct(*(a.alias(name(r)) for r, a in zip(runs, after, strict=True)), (acc["ended"] | (after[-1] == 0)).alias("ended"))

    begin = F.struct(*(F.lit(r).alias(name(r)) for r in runs), F.lit(False).alias("ended"))
    return F.aggregate(noise_marks(lines), begin, step)


def through(exit_: Column, run: Column) -> Column:
    """The run behind a segment that begins with `run`."""
    longest = exit_[f"r{CONTENTS_START}"]
    short = reduce(lambda rest, r: F.when(run == r, exit_[f"r{r}"]).otherwise(rest), range(CONTENTS_START), F.lit(None).cast("int"))
    return F.when(run < CONTENTS_START, short).when(exit_["ended"], longest).otherwise(run + longest - CONTENTS_START)


def without_noise(cut: DataFrame) -> DataFrame:
    """(key, seg, lines): drop_noise() of each whole text, segment by segment; segments left without lines stay out."""
    told = cut.select("key", "seg", exits(F.col("lines")).alias("exit"))
    # one short row a segment, so a text's list is as long as it has segments
    listed = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "exit"))).alias("all"))
    begin = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("runs"))
    step = lambda acc, x: F.struct(through(x["exit"], acc["run"]).alias("run"), F.concat(acc["runs"], F.array(acc["run"])).alias("runs"))
    runs = listed.select("key", F.posexplode(F.aggregate("all", begin, step)["runs"]).alias("seg", "run"))
    kept = cut.join(runs, ["key", "seg"]).select("key", "seg", drop_noise(F.col("lines"), F.col("run")).alias("lines"))
    return kept.filter(F.size("lines") > 0)


def begins_anew(line: Column, before: Column) -> Column:
    """Whether join_broken_lines() is sure to put nothing before this line into its paragraph, whatever is open: it or the
    line before is blank or a heading, or it stands alone or follows a sentence's end. Lines over LONG_LINE don't count, as
    what comes behind them depends on what was open."""
    ended = F.contains(F.lit(SENTENCE_ENDS), F.right(before, F.lit(1)))
    sure = (line == "") | line.startswith("#") | (before == "") | before.startswith("#")
    return sure | ((F.length(line) <= LONG_LINE) & (stands_alone(line) | ended))


def paragraphs(kept: DataFrame, script: str = HAN) -> DataFrame:
    """(key, stretch, items): join_broken_lines() of each whole text. A stretch goes from the first line of a segment that
    begins anew to the next such line of a later segment; texts without one are a single stretch."""
    inside = F.array_min(F.transform("lines", lambda x, i: F.when((i > 0) & begins_anew(x, F.get("lines", F.greatest(i - 1, F.lit(0)))), i)))
    by_seg = Window.partitionBy("key").orderBy("seg")
    edges = kept.select("key", "seg", inside.alias("inside"), F.get("lines", F.lit(0)).alias("first"), F.element_at("lines", -1).alias("last"))
    before = edges.withColumn("before", F.lag("last").over(by_seg))
    start = F.when(F.col("before").isNull() | begins_anew(F.col("first"), F.col("before")), 0).otherwise(F.col("inside"))
    opened = before.select("key", "seg", start.alias("start")).withColumn("own", F.when(F.col("start").isNotNull(), F.col("seg")))
    stretches = opened.withColumn("earlier", F.last("own", ignorenulls=True).over(by_seg.rowsBetween(Window.unboundedPreceding, -1)))
    size = F.size("lines")
    head = F.struct(F.col("earlier").alias("stretch"), F.slice("lines", F.lit(1), F.coalesce("start", size)).alias("part"))
    rest = F.struct(F.col("own").alias("stretch"), F.slice("lines", F.coalesce("start", size) + 1, size).alias("part"))
    halves = kept.join(stretches, ["key", "seg"]).select("key", "seg", F.inline(F.array(head, rest))).filter(F.size("part") > 0)
    whole = halves.repartition(tasks(kept), "key", "stretch").groupBy("key", "stretch").agg(F.array_sort(F.collect_list(F.struct("seg", "part"))).alias("parts"))
    lines = F.flatten(F.transform("parts", lambda p: p["part"]))
    return whole.select("key", "stretch", join_broken_lines(lines, script).alias("items"))


def blocks(joined: DataFrame, least: int = REPEAT_CHARS) -> DataFrame:
    """(key, block, text): the blocks between blank lines, of equal ones the first, as drop_repeated() keeps them. A block is
    put together in one task, since its digest takes all of it."""
    blank = lambda x: x == ""
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = joined.select("key", "stretch", F.size(F.filter("items", blank)).alias("blanks")).select("key", "stretch", F.coalesce(F.sum("blanks").over(earlier), F.lit(0)).alias("start"))
    rows = joined.select("key", "stretch", F.posexplode("items").alias("nth", "item"))
    within = F.sum(blank(F.col("item")).cast("long")).over(Window.partitionBy("key", "stretch").orderBy("nth"))
    numbered = rows.withColumn("within", within).filter("item <> ''").join(starts, ["key", "stretch"]).withColumn("block", F.col("start") + F.col("within"))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "nth", "item"))), lambda x: x["item"]), "\n")
    whole = numbered.groupBy("key", "block").agg(put.alias("text"))
    bare = F.regexp_replace("text", r"\s+", "")
    same = F.when(F.length(bare) < least, F.col("block").cast("string")).otherwise(F.sha2(bare, 256))
    return whole.groupBy("key", same.alias("same")).agg(F.min(F.struct("block", "text")).alias("b")).select("key", "b.*")


def clean_blocks(docs: DataFrame, key: str, text: str, script: str = HAN, per: int = SEGMENT) -> DataFrame:
    """(key, block, text): the blocks of each cleaned text, before marks are unified. One text of any length falls to many
    tasks; steps whose rows are read twice are staged. Keys are unique; null texts have no blocks."""
    kept = stage(without_noise(stage(cut_lines(docs, key, text, script, per), "cut")), "kept")
    return blocks(stage(paragraphs(kept, script), "joined"))


def normalised(docs: DataFrame, key: str, text: str, script: str = HAN, per: int = SEGMENT) -> DataFrame:
    """(key, text): equal to normalise(), with the folds' work dealt out by segments; a null text gives an empty one.

    A text of one segment is cleaned whole where it is, so only longer ones are staged and shuffled. These go by their
    digest: equal ones are cleaned once, and keys may repeat or be null.
    """
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    long = F.coalesce(F.regexp_count(unify_lines(F.col("text")), F.lit("\n")) >= per, F.lit(False)) if script == HAN else F.lit(True)
    short = given.filter(~long).select(F.col("id").alias(key), F.coalesce(normalise(F.col("text")), F.lit("")).alias(text))
    rows = given.filter(long).withColumn("own", F.sha2("text", 256))
    found = clean_blocks(rows.filter("text is not null").select("own", "text").dropDuplicates(["own"]), "own", "text", script, per)
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n\n")
    whole = found.groupBy("key").agg(put.alias("whole")).select(F.col("key").alias("own"), squeeze_blank_lines(unify_punctuation(F.col("whole"))).alias("clean"))
    cleaned = rows.select("id", "own").join(whole, "own", "left").select(F.col("id").alias(key), F.coalesce("clean", F.lit("")).alias(text))
    return cleaned.unionByName(short)
