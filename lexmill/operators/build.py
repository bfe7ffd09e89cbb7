"""Corpus build: names, classification, expansion of sources into candidates, choice of editions, manifest rows."""

from __future__ import annotations

import unicodedata
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.operators.chunking import strip
from lexmill.operators.corpus import BREAKER_COUNT, BREAKER_SHARE, edition_score, pick_editions, resolve_titles, split_compendium, volume_slug, yield_to_dedicated
from lexmill.operators.retrieval import ranked
from lexmill.session import remove, stage

# Name patterns with their school and role, marks of compendiums, label of their books, order of roles.
HEURISTICS = (
    ("温病|温热|卫气营血|三焦辨证|银翘|桑菊", "wenbing", "classic"),
    ("脾胃|补中益气|升阳益胃|东垣", "piwei", "classic"),
    ("火神|扶阳|钦安|四逆|附子", "huoshen", "classic"),
    ("参西|汇通|衷中", "integrative", "lecture"),
    ("倪海厦|汉唐|人纪|天纪", "nihaixia", "lecture"),
    ("医案|验案|临证", "*", "case"),
    ("伤寒|金匮|经方|仲景", "shanghan", "classic"),
)
ANY_SCHOOL = "shanghan"
COMPENDIUM_MARKERS = ("中医临床必读丛书典藏版", "现代著名老中医名著重刊丛书")
COMPENDIUM_LABEL = "中医临床必读丛书"
ROLE_ORDER = ("classic", "lecture", "case")
LAST_ROLE = 9
SLUG_CHARS, TITLE_CHARS = 40, 60


@F.pandas_udf(StringType())
def _compatible(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def plain_name(name: Column) -> Column:
    """NFKC form of a name. Only names with anything but ASCII leave the JVM, in Arrow batches."""
    return F.when(name.rlike(r"^\p{ASCII}*$"), name).otherwise(_compatible(F.when(~name.rlike(r"^\p{ASCII}*$"), name)))


def is_compendium(name: Column, markers: tuple[str, ...] = COMPENDIUM_MARKERS) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(name, F.lit(m)) for m in markers), F.lit(False))


def classified(name: Column, registry: list[tuple], heuristics: tuple = HEURISTICS, any_school: str = ANY_SCHOOL) -> Column:
    """Struct (school, role, title, slug, priority, basis) of a name; null where nothing fits.

    The first registry row (keyword, school, role, title, slug, priority) whose keyword the name holds decides, else the
    first heuristic (pattern, school, role), with title and slug made from the name; `*` stands for `any_school`. The
    tables are literals, so this is one expression a row: nothing is joined.
    """
    row = lambda school, role, title, slug, priority, basis: F.struct(
        F.lit(school).alias("school"), F.lit(role).alias("role"), title.cast("string").alias("title"), slug.cast("string").alias("slug"),
        F.lit(priority).cast("int").alias("priority"), F.lit(basis).alias("basis"),
    )
    slug = F.regexp_replace(F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_]+", "_"), 1, SLUG_CHARS), "^_+|_+$", "")
    title = F.substring(strip(F.element_at(F.split(name, r"\("), 1)), 1, TITLE_CHARS)
    found = [(F.contains(name, F.lit(k)), row(s, r, F.lit(t), F.lit(g), p, "registry")) for k, s, r, t, g, p in registry]
    found += [(name.rlike(pattern), row(any_school if s == "*" else s, r, title, slug, 50, "heuristic")) for pattern, s, r in heuristics]
    return reduce(lambda rest, f: F.when(f[0], f[1]).otherwise(rest), reversed(found), F.lit(None))


def expanded(sources: DataFrame, registry: list[tuple], books: DataFrame, markers: tuple[str, ...] = COMPENDIUM_MARKERS, heuristics: tuple = HEURISTICS, least: int = 3000) -> DataFrame:
    """Candidates and reports of cleaned sources (source, suffix, text); `source` is unique.

    (source, unit, status, reason, school, role, title, slug, work, priority, compendium, cited, suffix, text). A plain
    source gives one candidate or a skipped row. A compendium gives one for each of its books that `books` (book_title,
    slug, school, role, title, priority) knows; unknown volumes are skipped with a reason, and so is a compendium without
    volumes. Slugs of parted books carry their volume, `work` doesn't. Skipped rows have no text.
    """
    named = sources.withColumn("name", plain_name(F.col("source")))
    marked = named.withColumn("many", is_compendium(F.col("name"), markers))
    none = F.lit(None).cast("string")
    single = marked.filter(~F.col("many")).withColumn("m", classified(F.col("name"), registry, heuristics))
    single = single.select(
        "source", F.coalesce("m.title", F.lit("")).alias("unit"), F.when(F.col("m").isNull(), "skipped").otherwise("ready").alias("status"),
        F.when(F.col("m").isNull(), "not registered, and no pattern fits").alias("reason"), "m.school", "m.role", "m.title", "m.slug", F.col("m.slug").alias("work"), "m.priority",
        F.lit(False).alias("compendium"), F.col("source").alias("cited"), "suffix", F.when(F.col("m").isNotNull(), F.col("text")).alias("text"),
    )
    whole = marked.filter("many").select(F.col("source").alias("doc_id"), "suffix", "text")
    # written once: titles, books and what gave none are all read from it
    parts = stage(split_compendium(whole.select("doc_id", "text"), least).join(whole.select("doc_id", "suffix"), "doc_id"), "parts")
    known = resolve_titles(parts.select("title").distinct(), books.select("book_title", "slug")).select("title", F.col("slug").alias("found"))
    meta = books.select(F.col("slug").alias("found"), "school", "role", F.col("title").alias("named"), "priority").dropDuplicates(["found"])
    unit = F.when(F.col("volume") != "", F.concat("title", F.lit("·"), "volume")).otherwise(F.col("title"))
    # most books may bear a few titles: what a title means is joined to a book's place, and the text by that place alone
    place = parts.select("doc_id", "start", "title").join(known, "title", "left").join(meta, "found", "left").drop("title")
    met = parts.join(place, ["doc_id", "start"]).withColumn("unit", unit)
    unknown = F.col("school").isNull()
    book = met.select(
        F.col("doc_id").alias("source"), "unit", F.when(unknown, "skipped").otherwise("ready").alias("status"), F.when(unknown, "volume not registered").alias("reason"),
        "school", "role", F.col("named").alias("title"), volume_slug(F.col("found"), F.col("volume")).alias("slug"), F.col("found").alias("work"), "priority",
        F.lit(True).alias("compendium"), F.concat(F.lit(f"{COMPENDIUM_LABEL}·"), "unit").alias("cited"), "suffix", F.when(~unknown, F.col("text")).alias("text"),
    )
    empty = whole.join(parts.select("doc_id").distinct(), "doc_id", "left_anti").select(
        F.col("doc_id").alias("source"), F.lit("").alias("unit"), F.lit("skipped").alias("status"), F.lit("a compendium without volumes").alias("reason"),
        *(none.alias(c) for c in ("school", "role", "title", "slug", "work")), F.lit(None).cast("int").alias("priority"), F.lit(True).alias("compendium"),
        F.col("doc_id").alias("cited"), "suffix", none.alias("text"),
    )
    return single.unionByName(book).unionByName(empty)


def chosen(candidates: DataFrame) -> DataFrame:
    """The candidates that are written: compendium books yield to dedicated ones of the same work, and of the editions of a
    (school, slug) the best stays, ties to the lower source."""
    ready = candidates.filter("status = 'ready'")
    kept = yield_to_dedicated(ready.filter("compendium"), ready.filter("not compendium"), "work").select(*ready.columns).unionByName(ready.filter("not compendium"))
    score = edition_score(F.col("priority"), F.col("suffix"), F.length("text"))
    return pick_editions(kept, ["school", "slug"], score, "source").filter("chosen").drop("chosen", "score")


def stopped_by(frame: DataFrame, breaker: DataFrame) -> DataFrame:
    """The frame, unless the breaker's one row (`open`) says that too many sources were rejected: then reading it, and so
    any write of it, fails before anything is replaced."""
    open_ = breaker.select("open").scalar()
    return frame.filter(F.when(open_, F.raise_error(F.lit("too many sources were rejected: nothing is written"))).otherwise(F.lit(True)).cast("boolean"))


def published(frame: DataFrame, status: Column, target: str, count: int = BREAKER_COUNT, share: float = BREAKER_SHARE) -> dict[str, int | bool]:
    """Write a frame to a folder beside the target while its rows are counted, and put it in the target's place only if the
    breaker stays shut: one scan, and readers see the old rows or the new.

    The counts are observed metrics of the write itself. Rejected rows are those whose status begins so; they are counted,
    not written. What a shut-out run has written is removed. Returns `rows`, `rejected` and `open`.
    """
    spark = frame.sparkSession
    seen = Observation()
    rejected = status.startswith("rejected")
    beside = f"{target.rstrip('/')}-next-{uuid.uuid4().hex}"
    frame.observe(seen, F.count("*").alias("rows"), F.count_if(rejected).alias("rejected")).filter(~rejected | status.isNull()).write.parquet(beside)
    found = seen.get
    open_ = found["rejected"] >= count and found["rejected"] / max(1, found["rows"]) >= share
    if not open_:
        java = spark._jvm.org.apache.hadoop.fs.Path
        remove(spark, target)
        java(beside).getFileSystem(spark._jsc.hadoopConfiguration()).rename(java(beside), java(target))
    remove(spark, beside)
    return {"rows": found["rows"], "rejected": found["rejected"], "open": open_}


def sample_by_group(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """(group, key, nth): k rows of each group drawn by the MD5 of the key, those of least digest, in one pass.

    The least k of parts give the least k of the whole, so each task keeps k rows a group (a limit below the window's
    exchange) and no group is ranked whole in one task.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    return ranked(rows.select(group, key, digest.alias("digest")), group, F.asc("digest"), F.asc(key), k=k, rank="nth").drop("digest")


def role_rank(role: Column, order: tuple[str, ...] = ROLE_ORDER) -> Column:
    return reduce(lambda rest, i: F.when(role == order[i], i).otherwise(rest), range(len(order)), F.lit(LAST_ROLE))


def report_rows(reports: DataFrame, role: Column) -> DataFrame:
    """(school, role_rank, source, line): reports of (school, role, source, chunks, status) as lines of fixed width, sorted by
    school, role and source."""
    cells = [F.rpad(F.substring("source", 1, 34), 36, " "), F.rpad("school", 12, " "), F.rpad("role", 8, " "), F.lpad(F.col("chunks").cast("string"), 6, " ")]
    line = F.concat(*(x for c in cells for x in (c, F.lit(" "))), F.col("status"))
    return reports.select("school", role_rank(role).alias("role_rank"), "source", line.alias("line")).orderBy("school", "role_rank", "source")


def schools_written(documents: DataFrame) -> DataFrame:
    """(school, documents): what was written, by school."""
    return documents.groupBy("school").agg(F.count("*").alias("documents"))


def manifest_summary(entries: DataFrame) -> DataFrame:
    """One row (version, documents, chars, schools) of manifest entries: how many there are, and the schools in order."""
    return entries.agg(
        F.max("version").alias("version"), F.count("*").alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.array_join(F.array_sort(F.collect_set("school")), ",").alias("schools"),
    )
