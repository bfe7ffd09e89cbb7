"""Corpus building: cleaning, gates, classification, compendium splitting, choice of editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import HAN, count_of, half_up, let, scan, squeeze_blank_lines, unify_lines, unify_punctuation
from lexmill.operators.chunking import strip
from lexmill.operators.matching import containing
from lexmill.session import stage

# Noise patterns, limits and weights of the corpus rules.
ADVERT = (
    r"(?i)(z-?library|1lib|z-lib|扫码|二维码|关注(公众)?号|微信号|加群|QQ群|免费下载|电子书|侵权|删除|仅供(学习|参考|交流)|请支持正版|淘宝|微店|"
    r"更多(电子书|资源)|www\.[a-z0-9\-]+\.[a-z]{2,}|https?://|@gmail|@qq\.com)"
)
DECORATION = r"^\s*[-=*~_—·◇◆※☆★]{3,}\s*$"
PAGE_NUMBER = r"^\s*[-—–\[【(]*\s*\d{1,4}\s*[-—–\]】)]*\s*$"
RUNNING_HEAD = r"(?i)^\s*(第\s*[一二三四五六七八九十百零\d]+\s*(页|章|节|卷|篇)|Page\s*\d+|\d+\s*/\s*\d+|.{0,20}(z-?library|1lib|z-lib).{0,20})\s*$"
CONTENTS_DOTS = r"[.·。…]{3,}\s*\d+\s*$"
CONTENTS_LEADER = r"^\s*\S.{0,40}?[\s.]{3,}\d{1,4}\s*$"
CONTENTS_TAIL = r"^.{2,40}?\s{2,}\d{1,4}\s*$"
SENTENCE_ENDS = "。！？；：」』）】…!?;:"
OPENERS = "「『（(【["
HEADING = (
    r"^\s*(第[一二三四五六七八九十百千\d]+[条章节篇卷回]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十\d]{1,3}[)）]|【.{1,20}】|"
    r"[A-Za-z一-鿿]{2,12}(方|汤|散|丸|饮|证|论|篇|法|病|门)\s*$)"
)
CHAPTER = r"^(第[一二三四五六七八九十百\d]+[章卷篇回]|\s*[一二三四五六七八九十]+\s*$)"
IMPRINT = r"图书在版编目\s*[（(]\s*CIP\s*[)）]\s*数\s*据"
FIELD_LINE = (
    r"^\s*(整理|著|撰|编|校|重订|点校|出版发行|地\s*址|邮\s*编|E\s*-?\s*mail|制作单位|排\s*版|制作时间|版\s*本\s*号|格\s*式|标准书号|ISBN|"
    r"策划编辑|责任编辑|打击盗版|出版者的话|图书在版编目)"
)
PUBLISHER = r"出版发行|出版社|有限公司|音像|电子音像|出版者的话"
VOLUME = r"[.．·]\s*([上中下])\s*$|[（(]\s*([上中下])\s*[)）]\s*$"
PREFACE_END = r"^#{1,3}\s*(整理说明|重订说明|校注说明|点校说明|凡例)\s*$"
VOLUME_SLUGS = {"上": "shang", "中": "zhong", "下": "xia"}
FORMAT_WEIGHTS = {".md": 25, ".epub": 20, ".azw": 15, ".mobi": 15, ".pdf": 5}
ADVERT_CHARS, CONTENTS_RUN, CONTENTS_START = 120, 400, 3
FRONT_LINES, FRONT_CHARS = 400, 40
REPEAT_CHARS, SHORT_LINE, LONG_LINE = 60, 18, 600
LEAST_CHARS, LEAST_RATIO = 20_000, 0.55
BREAKER_COUNT, BREAKER_SHARE = 3, 0.34
LEAST_BOOK = 3000


def quality_columns(text: Column, script: str = HAN, advert: str = ADVERT) -> list[Column]:
    """Size, script share, lines, line length and noise of a text."""
    size, lines = F.greatest(F.length(text), F.lit(1)), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    some = F.greatest(lines, F.lit(1))
    return [
        F.length(text).alias("chars"), half_up(count_of(text, script) / size, 4).alias("script_ratio"), lines.alias("lines"),
        half_up(size / some, 1).alias("avg_line"), half_up(F.regexp_count(text, F.lit(advert)) / some, 4).alias("noise_ratio"),
    ]


def gate_status(chars: Column, ratio: Column, least: int = LEAST_CHARS, share: float = LEAST_RATIO) -> Column:
    return F.when(chars < least, "rejected: short").when(ratio < share, "rejected: script").otherwise("accepted")


def breaker_open(reports: DataFrame, status: Column) -> Column | DataFrame:
    """One row: whether so many sources were rejected that nothing may be written or swept."""
    rejected = F.count_if(status.startswith("rejected"))
    return reports.agg(((rejected >= BREAKER_COUNT) & (rejected / F.greatest(F.count("*"), F.lit(1)) >= BREAKER_SHARE)).alias("open"))


def drop_front(lines: Column, script: str = HAN) -> Column:
    """Lines from the first long line of running text on, if the first 400 lines hold one."""
    def cut(all_: Column) -> Column:
        long = lambda x, i: F.when((F.length(strip(x)) >= FRONT_CHARS) & x.rlike(f"[{script}]"), i)
        first = F.coalesce(F.array_min(F.transform(F.slice(all_, 1, FRONT_LINES), long)), F.lit(0))
        return F.slice(all_, first + 1, F.greatest(F.size(all_) - first, F.lit(0)))

    return let(lines, cut)


def noise_marks(lines: Column) -> Column:
    """Stripped lines with what of the noise rules depends on the line alone: (line, noise, sure, tail)."""
    def told(line: Column) -> Column:
        noise = ((F.length(line) < ADVERT_CHARS) & line.rlike(ADVERT)) | line.rlike(DECORATION) | line.rlike(PAGE_NUMBER) | line.rlike(RUNNING_HEAD)
        return F.struct(line.alias("line"), noise.alias("noise"), (line.rlike(CONTENTS_DOTS) | line.rlike(CONTENTS_LEADER)).alias("sure"), line.rlike(CONTENTS_TAIL).alias("tail"))

    return F.transform(lines, lambda raw: let(strip(raw), told))


def in_contents(item: Column, run: Column) -> Column:
    """Whether a marked line counts as one of a table of contents after `run` such lines."""
    return item["sure"] | (item["tail"] & (run >= CONTENTS_START))


def run_after(item: Column, run: Column) -> Column:
    """Length of the run of contents lines after a marked line."""
    return F.when((item["line"] == "") | item["noise"], run).when(in_contents(item, run), run + 1).otherwise(0)


def drop_noise(lines: Column, run: Column | None = None) -> Column:
    """Without adverts, decoration, page numbers, running heads and tables of contents.

    A fold carries the length of the current run of contents lines: blank and other dropped lines don't end it, a line
    of text does. Lines that only end in a number count once a run has started; past 400 lines a run is kept. What
    depends on the line alone is matched before the fold, once a line. `run` is the run before the first line.
    """
    def step(acc: Column, item: Column) -> tuple[Column, dict[str, Column]]:
        line, before = item["line"], acc["run"]
        drop = (line != "") & (item["noise"] | (in_contents(item, before) & (before < CONTENTS_RUN)))
        return F.when(drop, F.array().cast("array<string>")).otherwise(F.array(line)), {"run": run_after(item, before)}

    return let(noise_marks(lines), lambda all_: scan(all_, {"run": F.lit(0) if run is None else run}, step))


def stands_alone(line: Column) -> Column:
    """Whether a line never continues the one before it."""
    return line.rlike(HEADING) | line.rlike(CHAPTER) | line.rlike(PAGE_NUMBER) | F.contains(F.lit(OPENERS), F.left(line, F.lit(1)))


def join_broken_lines(lines: Column, script: str = HAN) -> Column:
    """Physical lines joined into paragraphs, headings and sentence ends kept apart. What depends on the line alone is
    matched before the fold, once a line."""
    none = F.array().cast("array<string>")
    one = lambda x: F.when(x != "", F.array(x)).otherwise(none)

    def told(line: Column) -> Column:
        return F.struct(line.alias("line"), stands_alone(line).alias("alone"), line.rlike(f"^[{script}]").alias("script"))

    def step(acc: Column, item: Column) -> tuple[Column, dict[str, Column]]:
        line, held = item["line"], acc["open"]
        end = F.right(held, F.lit(1))
        apart = item["alone"] | (F.length(held) <= SHORT_LINE) | F.contains(F.lit(SENTENCE_ENDS), end)
        glue = F.when(item["script"] & end.rlike(f"[{script}]"), "").otherwise(" ")
        text = F.when(held == "", line).when(apart, line).otherwise(F.concat(held, glue, line))
        full = F.length(text) > LONG_LINE
        body = F.concat(F.when((held != "") & apart, one(held)).otherwise(none), F.when(full & (held != ""), one(text)).otherwise(none))
        finished = F.when(line == "", F.concat(one(held), F.array(F.lit("")))).when(line.startswith("#"), F.concat(one(held), F.array(line, F.lit("")))).otherwise(body)
        left = F.when((line == "") | line.startswith("#") | (full & (held != "")), "").otherwise(text)
        return finished, {"open": left}

    return let(F.transform(lines, lambda raw: let(strip(raw), told)), lambda all_: scan(all_, {"open": F.lit("")}, step, lambda acc: one(acc["open"])))


def drop_repeated(blocks: Column, least: int = REPEAT_CHARS) -> Column:
    """First of equal blocks, white space aside; short blocks always stay."""
    def key(block: Column, i: Column) -> Column:
        return let(F.regexp_replace(block, r"\s+", ""), lambda x: F.when(F.length(x) < least, i.cast("string")).otherwise(F.sha2(x, 256)))

    def first(all_: Column) -> Column:
        """Sorted by key and place, the first of each key leads its run; back in order, these are the blocks that stay."""
        placed = F.sort_array(F.transform(F.transform(all_, key), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        leads = lambda ps: F.filter(ps, lambda p, n: (n == 0) | (F.get(ps, F.greatest(n - 1, F.lit(0)))["k"] != p["k"]))
        return F.transform(F.sort_array(F.transform(let(placed, leads), lambda p: p["i"])), lambda i: F.get(all_, i))

    return let(blocks, first)


def normalise(text: Column, convert: Column | None = None) -> Column:
    """The whole cleaning chain, in its order; `convert` replaces the text after line ends are unified (script conversion)."""
    lines = F.split(unify_lines(text) if convert is None else convert, "\n")
    joined = F.array_join(join_broken_lines(drop_noise(drop_front(lines))), "\n")
    return squeeze_blank_lines(unify_punctuation(F.array_join(drop_repeated(F.split(joined, "\n\n")), "\n\n")))


def first_match(name: Column, registry: list[tuple]) -> Column:
    """Struct (keyword, school, role, priority) of the first registry row whose keyword the name holds; null where none fits.

    The registry is a list of literals, so the choice is one expression: nothing is joined or shuffled.
    """
    row = lambda k, s, r, p: F.struct(F.lit(k).alias("keyword"), F.lit(s).alias("school"), F.lit(r).alias("role"), F.lit(p).alias("priority"))
    out = F.lit(None)
    for keyword, school, role, priority in reversed(registry):
        out = F.when(F.contains(name, F.lit(keyword)), row(keyword, school, role, priority)).otherwise(out)
    return out


def resolve_titles(titles: DataFrame, registry: DataFrame, least: int = 4) -> DataFrame:
    """(title, slug, how): the exact title, else the only one that contains it or lies in it, if long enough.

    Both directions are joins on signatures (containing), so neither table has to be small.
    """
    exact = titles.join(registry.select(F.col("book_title").alias("title"), F.col("slug").alias("exact")), "title", "left")
    open_ = titles.join(registry.select(F.col("book_title").alias("title")), "title", "left_anti").select("title").distinct()
    near = registry.filter(F.length("book_title") >= least).select("book_title", F.col("slug").alias("near")).distinct()
    books = near.select("book_title").distinct()
    either = containing(open_, books, "title", "title", "book_title", "book_title").unionByName(containing(books, open_, "book_title", "book_title", "title", "title"))
    counted = either.distinct().join(near, "book_title").groupBy("title").agg(F.count("near").alias("n"), F.min("near").alias("near"))
    found = exact.join(counted, "title", "left").withColumn("n", F.coalesce("n", F.lit(0))).dropDuplicates(["title", "exact"])
    fuzzy = F.when(F.col("n") == 1, F.col("near"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "contained").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return found.select("title", F.coalesce("exact", fuzzy).alias("slug"), how.alias("how"))


def edition_score(priority: Column, suffix: Column, size: Column) -> Column:
    """Priority first, then the format's weight, then the size."""
    weight = F.lit(0)
    for name, value in FORMAT_WEIGHTS.items():
        weight = F.when(F.lower(suffix) == name, value).otherwise(weight)
    return priority.cast("long") * 1_000_000_000 + weight.cast("long") * 1_000_000 + F.least(size.cast("long"), F.lit(999_999))


def pick_editions(rows: DataFrame, work: list[str], score: Column, tie: str) -> DataFrame:
    """Every row with `chosen`: the best edition of each work, ties to the lower `tie`."""
    place = F.row_number().over(Window.partitionBy(*work).orderBy(F.desc("score"), F.asc(tie)))
    return rows.withColumn("score", score).withColumn("chosen", place == 1)


def yield_to_dedicated(compendium: DataFrame, dedicated: DataFrame, work: str) -> DataFrame:
    """Compendium rows whose work has no dedicated book, whatever the volume."""
    return compendium.join(dedicated.select(work).distinct(), work, "left_anti")


def split_title(raw: Column) -> tuple[Column, Column]:
    """Title and volume mark of a title line."""
    line = strip(F.translate(raw, "／．—－", "/.--"))
    volume = F.concat(F.regexp_extract(line, VOLUME, 1), F.regexp_extract(line, VOLUME, 2))
    return F.regexp_replace(F.regexp_replace(line, VOLUME, ""), r"^[．.· ]+|[．.· ]+$", ""), volume


def volume_slug(slug: Column, volume: Column) -> Column:
    out = slug
    for mark, name in VOLUME_SLUGS.items():
        out = F.when(volume == mark, F.concat(slug, F.lit("_" + name))).otherwise(out)
    return out


def split_compendium(docs: DataFrame, least: int = LEAST_BOOK) -> DataFrame:
    """(doc_id, title, volume, start, stop, basis, text): books of compendium texts of (doc_id, text).

    A book starts at its imprint; its title stands in one of the next eleven lines. The first book may have only a
    standard number, with the title above it. Preface lines are cut up to the heading after the last preface mark.
    Fewer than two books: none. Look-ups are window frames over the few lines that carry a mark, without the text; a text is
    split once, in its own row, and moved at most once, to where its books are known. `doc_id` names a document once.
    """
    split = F.split(unify_lines(F.col("text")), "\n")
    lines = docs.select("doc_id", F.posexplode(split).alias("pos", "line"))
    by_line = Window.partitionBy("doc_id").orderBy("pos")
    plain = strip(F.translate("line", "／．—－", "/.--"))
    title_line = ~plain.rlike("ISBN|CIP") & F.contains(plain, F.lit("/")) & F.contains(plain, F.lit("出版社")) & (split_title(F.element_at(F.split(plain, "/"), 1))[0] != "")
    head_line = (
        ~F.col("line").rlike(FIELD_LINE) & ~F.col("line").rlike(PUBLISHER) & ~F.col("line").rlike("[：:A-Za-z0-9]") & F.length(strip(F.col("line"))).between(2, 20)
    )
    marks = lines.select(
        "doc_id", "pos", F.when(title_line, F.element_at(F.split(plain, "/"), 1)).alias("title"), F.when(head_line, F.col("line")).alias("head"),
        F.col("line").rlike(IMPRINT).alias("imprint"), F.col("line").rlike(r"^\s*(标准书号|ISBN)").alias("number"),
        F.col("line").rlike(PREFACE_END).alias("ends_preface"), F.col("line").rlike(r"^#{1,3}\s+\S").alias("heading"),
    ).filter("title is not null or head is not null or imprint or number or ends_preface or heading")
    # few and short, but asked for several times: the lines are gone through once
    marks = stage(marks, "marks")
    ahead = F.min(F.when(F.col("title").isNotNull(), F.struct("pos", F.col("title").alias("raw")))).over(by_line.rangeBetween(1, 11))["raw"]
    above = F.max(F.when(F.col("head").isNotNull(), F.struct("pos", F.col("head").alias("raw")))).over(by_line.rangeBetween(-59, -1))["raw"]
    seen = marks.select("*", ahead.alias("ahead"), above.alias("above"))
    imprints = seen.filter(F.col("imprint") & F.col("ahead").isNotNull()).select("doc_id", F.col("pos").alias("start"), F.col("ahead").alias("raw"), F.lit("cip").alias("basis"))
    first = imprints.groupBy("doc_id").agg(F.min("start").alias("first"))
    numbers = seen.filter("number").join(first, "doc_id").filter("pos < first")
    head = numbers.groupBy("doc_id").agg(F.min_by("above", "pos").alias("raw")).filter("raw is not null").select("doc_id", F.lit(0).alias("start"), "raw", F.lit("isbn").alias("basis"))
    starts = imprints.unionByName(head)
    title, volume = split_title(F.col("raw"))
    per_doc = Window.partitionBy("doc_id")
    books = starts.select("doc_id", "start", title.alias("title"), volume.alias("volume"), "basis", F.lead("start").over(per_doc.orderBy("start")).alias("stop"), F.count("*").over(per_doc).alias("n")).filter("n > 1")
    inside = marks.filter("ends_preface or heading").select("doc_id", "pos", "ends_preface", "heading").join(books.select("doc_id", "start", "stop"), "doc_id")
    inside = inside.filter("pos >= start and (stop is null or pos < stop)")
    cut = F.max(F.when(F.col("ends_preface") & (F.col("pos") - F.col("start") < 3000) & (F.col("pos") > F.col("start")), F.col("pos"))).over(Window.partitionBy("doc_id", "start"))
    begins = inside.withColumn("cut", cut).groupBy("doc_id", "start").agg(F.min(F.when((F.col("pos") > F.col("cut")) & F.col("heading"), F.col("pos"))).alias("begin"))
    placed = books.join(begins, ["doc_id", "start"], "left").withColumn("begin", F.coalesce("begin", "start"))
    of_doc = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "begin", "title", "volume", "basis"))).alias("books"))

    def cut_out(rows: Column) -> Column:
        def one(book: Column) -> Column:
            stop = F.coalesce(book["stop"], F.size(rows))
            text = strip(F.array_join(F.slice(rows, book["begin"] + 1, stop - book["begin"]), "\n"))
            return F.struct(book["title"].alias("title"), book["volume"].alias("volume"), book["start"].alias("start"), stop.alias("stop"), book["basis"].alias("basis"), text.alias("text"))

        return F.filter(F.transform("books", one), lambda b: F.length(b["text"]) >= least)

    found = docs.join(of_doc, "doc_id").select("doc_id", let(split, cut_out).alias("found"))
    return found.filter(F.size("found") > 1).select("doc_id", F.inline("found"))
