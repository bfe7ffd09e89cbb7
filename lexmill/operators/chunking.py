"""Chunking: folds over a document's lines, as array expressions, so each document stays in its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import HAN, clean_markdown, let, scan, script_ratio, sections

# Sizes, gates and boundary patterns of the three kinds of text.
CLASSIC, CASE, LECTURE, OVERLAP = 620, 760, 680, 90
CLASSIC_UNIT, CASE_UNIT, CASE_LEAST = 240, 300, 90
LEAST_CHARS, LEAST_RATIO = 36, 0.30
CLAUSE = (
    r"^\s*(?:第\s*[一二三四五六七八九十百零\d]{1,4}\s*条|[（(]\s*\d{1,3}\s*[)）]|\d{1,3}\s*[、.．]|[一二三四五六七八九十]{1,3}\s*[、.．])\s*"
)
CASE_START = (
    r"^\s*(?:(?:医)?案\s*[一二三四五六七八九十百\d]{1,3}|病案\s*[一二三四五六七八九十百\d]{1,3}|例\s*[一二三四五六七八九十百\d]{1,3}"
    r"|[男女][，,、]?\s*\d{1,3}\s*岁|\d{4}\s*年\s*\d{1,2}\s*月|\d{1,3}\s*[、.．]\s*[男女某患者])"
)

STRIP = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def full_lines(block: Column) -> Column:
    """Stripped lines of a block that aren't empty."""
    return F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")


def windows(text: Column, size: int, step: int) -> Column:
    """Pieces of `size` characters that start every `step` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def fold(items: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Left fold with a list of finished pieces and an open one; step gives what is finished now and what stays open."""
    def merge(acc: Column, item: Column) -> tuple[Column, dict[str, Column]]:
        finished, left = step(acc["open"], item)
        return finished, {"open": left}

    return let(items, lambda all_: scan(all_, {"open": F.lit("")}, merge, lambda acc: closed(acc["open"])))


def closed(piece: Column) -> Column:
    """The piece as a list, or no piece if it is empty."""
    return F.when(piece != "", F.array(piece)).otherwise(F.array().cast("array<string>"))


def appended(piece: Column, line: Column) -> Column:
    return F.when(piece == "", line).otherwise(F.concat(piece, F.lit("\n"), line))


def pack_units(units: Column, size: int) -> Column:
    """Whole units joined up to `size` characters; a longer unit is cut, apart from its neighbours."""
    def step(piece: Column, unit: Column) -> tuple[Column, Column]:
        long, fits = F.length(unit) > size, (piece == "") | (F.length(piece) + F.length(unit) + 1 <= size)
        finished = F.when(long, F.concat(closed(piece), windows(unit, size, size))).when(fits, F.array().cast("array<string>")).otherwise(closed(piece))
        return finished, F.when(long, "").when(fits, appended(piece, unit)).otherwise(unit)

    return fold(F.filter(F.transform(units, strip), lambda x: x != ""), step)


def group_lines(lines: Column, opens: Callable[[Column, Column], Column], size: int) -> Column:
    """Lines gathered into units: a boundary line opens a new one, and so does a line that would make it too long."""
    def step(unit: Column, line: Column) -> tuple[Column, Column]:
        join = ~opens(unit, line) & (F.length(unit) + F.length(line) <= size)
        return F.when(join, F.array().cast("array<string>")).otherwise(closed(unit)), F.when(join, appended(unit, line)).otherwise(line)

    return fold(lines, step)


def classic_chunks(block: Column) -> Column:
    """Clauses stay whole and are packed to 620 characters."""
    return pack_units(group_lines(full_lines(block), lambda unit, line: line.rlike(CLAUSE) & (unit != ""), CLASSIC_UNIT), CLASSIC)


def case_chunks(block: Column) -> Column:
    """Cases stay whole and are packed to 760 characters."""
    return pack_units(group_lines(full_lines(block), lambda unit, line: line.rlike(CASE_START) & (F.length(unit) >= CASE_LEAST), CASE_UNIT), CASE)


def lecture_chunks(block: Column) -> Column:
    """Paragraphs packed to 680 characters, the last 90 carried over; a longer paragraph gives windows of its own."""
    def step(piece: Column, para: Column) -> tuple[Column, Column]:
        long, fits = F.length(para) > LECTURE, F.length(piece) + F.length(para) + 1 <= LECTURE
        tail = strip(F.concat(F.right(piece, F.lit(OVERLAP)), F.lit("\n"), para))
        finished = F.when(long, F.concat(closed(piece), windows(para, LECTURE, LECTURE - OVERLAP))).when(fits, F.array().cast("array<string>")).otherwise(closed(piece))
        return finished, F.when(long, "").when(fits, appended(piece, para)).otherwise(F.when(F.length(piece) > OVERLAP, tail).otherwise(para))

    return fold(full_lines(block), step)


#: Chunker of each role; other roles are treated as classic.
STRATEGIES: dict[str, Callable[[Column], Column]] = {"classic": classic_chunks, "case": case_chunks, "lecture": lecture_chunks}


def gated(piece: Column, script: str = HAN, least: int = LEAST_CHARS, ratio: float = LEAST_RATIO) -> Column:
    """kept, or the first gate that drops the piece: short, then low_script."""
    return F.when(F.length(piece) < least, "short").when(script_ratio(piece, script) < ratio, "low_script").otherwise("kept")


def front_matter(raw: Column) -> tuple[Column, Column]:
    """Map of the leading `key: value` block, the later of equal keys winning, and the text after it."""
    head = F.regexp_extract(raw, r"(?s)\A---\s*\n(.*?)\n---\s*\n?", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    last = let(entries, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_) + 1), lambda later: later["k"] == e["k"])))
    return F.map_from_entries(last), F.regexp_replace(raw, r"(?s)\A---\s*\n.*?\n---\s*\n?", "")


def document_chunks(docs: DataFrame, script: str = HAN) -> DataFrame:
    """One row a kept chunk of (school, source, title, role, text) documents, with its header and its place.

    The front matter overrides school, title and role. Sections are chunked by the role's strategy, gated, and numbered
    within the document after the gates. The statistics of the gates are in chunk_pieces().
    """
    kept = chunk_pieces(docs, script).filter("status = 'kept'")
    order = Window.partitionBy("school", "source").orderBy("section_no", "piece_no")
    label = F.when(F.col("section") != "", F.col("section")).otherwise(F.col("title"))
    text = F.concat(F.lit("【"), "title", F.lit("·"), label, F.lit("】\n"), "piece")
    index = F.row_number().over(order) - 1
    key = F.substring(F.concat_ws("::", "source", F.substring(label, 1, 280), index.cast("string"), F.substring(text, 1, 48)), 1, 640)
    return kept.select(
        "school", "source", F.substring(label, 1, 280).alias("section"), F.substring("title", 1, 180).alias("title"), "role",
        index.alias("chunk_index"), text.alias("content"), key.alias("token_key"),
    )


def chunk_pieces(docs: DataFrame, script: str = HAN) -> DataFrame:
    """Every piece of every section with the gate's verdict, before numbering."""
    meta, body = front_matter(F.col("text"))
    named = docs.withColumn("meta", meta).withColumn("body", clean_markdown(body))
    over = lambda k: F.coalesce(F.get(F.map_values(F.map_filter("meta", lambda a, b: (a == k) & (b != ""))), F.lit(0)), F.col(k))
    title = over("title")
    named = named.select("source", over("school").alias("school"), F.when(title != "", title).otherwise(F.col("source")).alias("title"), over("role").alias("role"), "body")
    cut = named.select("*", F.posexplode(sections(F.col("body"))).alias("section_no", "part"))
    body = F.col("part")["body"]
    pieces = F.when(F.col("role") == "case", case_chunks(body)).when(F.col("role") == "lecture", lecture_chunks(body)).otherwise(classic_chunks(body))
    rows = cut.select("school", "source", "title", "role", "section_no", F.col("part")["title"].alias("section"), F.posexplode(pieces).alias("piece_no", "raw"))
    rows = rows.withColumn("piece", strip(F.col("raw"))).drop("raw")
    return rows.withColumn("status", gated(F.col("piece"), script))


def chunk_statistics(pieces: DataFrame) -> DataFrame:
    """Kept and dropped pieces and sections of each document."""
    of = lambda s: F.count_if(F.col("status") == s)
    return pieces.groupBy("school", "source", "role").agg(
        of("kept").alias("total"), of("short").alias("dropped_short"), of("low_script").alias("dropped_low_script"), F.countDistinct("section_no").alias("sections")
    )
