"""Corpus build, opinion and questionnaire queries."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lexmill.functions.text import clean_markdown, half_up, squeeze_blank_lines, unify_lines, unify_punctuation, words
from lexmill.functions.vectors import fit_dimension
from lexmill.operators import build, evaluation, opinions
from lexmill.operators.chunking import front_matter
from lexmill.operators.retrieval import dense_top_k, ranked
from lexmill.operators.rules import UNSURE
from lexmill.plans.search import hybrid_search, table, vector_queries
from lexmill.session import remove, shared_dir, stage
from lexmill.sources.binary import extracted, extraction_report
from lexmill.sources.files import books, current, epub_bytes, palm_bytes, place, read_committed, remove_committed, write_files, written_list
from lexmill.sources.knowledge import manifest, read_documents, read_state, read_written, rendered, write_documents, write_state
from lexmill.streaming.ingest import consultation_events, frame, reassembled

#: Parameters for the given tables.
MARKERS = ("src1", "src2")
REGISTRY = [("-fr-1", "piwei", "case", "French ones", "french_one", 70), ("-de", "wenbing", "lecture", "German", "german", 60)]
PATTERNS = (("-fr-[2-5]", "huoshen", "classic"), ("-es-.*[05]$", "*", "case"))
BOOKS = [("book en", "book_en", "shanghan", "classic", "English", 80), ("volume de", "volume_de", "piwei", "case", "Deutsch", 80), ("livre fr", "livre_fr", "common", "lecture", "Livre", 75)]
TITLES = {"en": "book en．上", "de": "volume de", "fr": "livre fr（下）", "es": "unknown es"}
LEAST = 500
CIP = "图书在版编目（CIP）数据"
DOMAIN = ("the", "and", "of", "in", "is", "on")
SCHOOLS = ["shanghan", "wenbing", "piwei", "system", "user"]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width names back in plain form, addresses without case and blanks, keys of cached orders."""
    plain = "".join(map(chr, range(33, 127)))
    wide = F.translate("c_name", plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    address = F.lower(F.trim(F.concat(F.lit("  "), "c_name", F.lit("@Example.ORG "))))
    key = F.sha2(F.concat_ws("\x01", "c_name", F.col("c_custkey").cast("string")), 256)
    return table(spark, sf_dir, "customer").select("c_custkey", build.plain_name(wide).alias("name"), address.alias("address"), key.alias("cache_key"))


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string")).alias("name"), "text")


def name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry first, then patterns with a slug and title made from the name."""
    docs = named_documents(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" (x)")))
    found = docs.select("doc_id", build.is_compendium(F.col("name"), MARKERS).alias("compendium"), build.classified(F.col("name"), REGISTRY, PATTERNS[:1] + (("-es-", "*", "case"),)).alias("m"))
    return found.select("doc_id", "compendium", "m.*").fillna("", ["school", "role", "title", "slug", "basis"]).fillna(0, ["priority"])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their own; of the sources with a mark, one compendium for each 50 ids."""
    docs = named_documents(spark, sf_dir).withColumn("group", F.concat_ws("-", F.element_at(F.split("name", "-"), 1), F.floor(F.col("doc_id") / 50).cast("string")))
    title = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv)), F.col("lang")), F.lit("none"))
    part = F.concat(F.lit(f"{CIP}\n\n"), title, F.lit("/x．-y：人民卫生出版社\n"), F.regexp_replace("text", r"[\r\n]+", " "), F.lit("\n"))
    marked = build.is_compendium(F.col("group"), MARKERS)
    whole = docs.filter(marked).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("part")))).alias("parts"))
    many = whole.select(F.col("group").alias("source"), F.lit(".pdf").alias("suffix"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))
    single = docs.filter(~marked).select(F.col("name").alias("source"), F.lit(".md").alias("suffix"), "text")
    return single.unionByName(many)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = spark.createDataFrame(BOOKS, "book_title string, slug string, school string, role string, title string, priority int")
    return build.expanded(sources(spark, sf_dir), REGISTRY, books, MARKERS, PATTERNS, LEAST)


def source_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source gives: candidates, books of compendiums, and rows that are skipped with a reason."""
    rows = candidates(spark, sf_dir).select("source", "unit", "status", "reason", "school", "role", "slug", "work", "cited", F.length("text").alias("chars"))
    return rows.fillna("", ["reason", "school", "role", "slug", "work"]).fillna(0, ["chars"])


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries of documents rendered with their front matter; the digest is that of the file."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    file = rendered(F.col("title"), F.col("lang"), F.lit("classic"), F.col("source"), F.col("text"))
    named = docs.select(
        F.col("lang").alias("school"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("slug"), "source", F.col("title").alias("unit"),
        F.md5(file.cast("binary")).alias("digest"), F.lit("classic").alias("role"), "title", F.length("text").alias("chars"),
    )
    return manifest(named)


def manifest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest says of all its entries."""
    return build.manifest_summary(manifest_rows(spark, sf_dir))


def turn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a frame whose data is the turn in JSON."""
    turns = table(spark, sf_dir, "conversations")
    data = F.to_json(F.struct("conv_id", "turn", "text"))
    return turns.select("conv_id", "turn", F.md5(frame(F.col("role"), data).cast("binary")).alias("digest"), F.length(data).alias("size"))


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the report beside the number of documents of the school."""
    docs = table(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 3 == 0, "case").when(F.col("doc_id") % 3 == 1, "classic").otherwise("other")
    rows = docs.select(F.col("lang").alias("school"), role.alias("role"), F.concat_ws("-", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("source"), F.length("text").alias("chunks"), F.lit("ready").alias("status"))
    counts = build.schools_written(rows)
    return build.report_rows(rows, F.col("role")).join(counts, "school").orderBy("school", "role_rank", "source")


def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and characters sent to the encoder, by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("tokens"))


def opinions_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of conversation turns, read back as typed opinions."""
    turns = table(spark, sf_dir, "conversations")
    evidence = F.when(F.col("turn") % 3 == 0, F.to_json(F.array("role", "text"))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.col("text").alias("v"))))
    said = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("diagnosis"), (F.col("turn") / 4).cast("string").alias("confidence"), F.col("role").alias("formula")))
    listed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"evidence":'), evidence)).when(F.col("turn") % 3 == 1, F.concat(F.lit(',"evidence":'), F.regexp_extract(evidence, r'(?s)^\{"v":(.*)\}$', 1))).otherwise("")
    reply = F.concat(F.regexp_replace(said, r"\}$", ""), listed, F.lit("}"))
    profiles = spark.createDataFrame([("user", "User", "asks"), ("assistant", "Assistant", "answers")], "school string, name string, title string")
    read = turns.select("conv_id", "turn", F.col("role").alias("school"), opinions.opinion(reply).alias("o"))
    rows = opinions.with_profile(read, profiles).select("conv_id", "turn", "name", "o.diagnosis", "o.confidence", F.array_join("o.evidence", "\x01").alias("evidence"), "o.mechanism", "o.formula")
    return rows.fillna("", ["name", "formula"])


def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last words of each role as facts, one line each."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))
    facts = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("facts"))
    return facts.select("conv_id", F.md5(opinions.facts_text(F.col("facts")).cast("binary")).alias("digest"), opinions.fallback_opinion(F.col("facts"))["diagnosis"].alias("fallback"))


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt context of each source: its first documents, numbered, labelled and cut to the budget."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("source").alias("title"), F.col("lang").alias("section"), F.col("text").alias("content"))
    found = opinions.context_text(docs, "source", "doc_id", F.lit("classic"))
    return found.select("source", F.length("context").alias("chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


def intake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a complaint: its words as clues and modules; turn 0 stands for a reply that failed."""
    turns = table(spark, sf_dir, "conversations")
    bag = words(F.col("text"))
    school = F.when(F.col("turn") > 0, F.col("role"))
    read = turns.select("conv_id", "turn", opinions.intake(F.col("text"), school, SCHOOLS, bag, bag, list(DOMAIN)).alias("i"))
    return read.select("conv_id", "turn", F.md5(F.col("i.summary").cast("binary")).alias("digest"), "i.school", F.array_join("i.clues", " ").alias("clues"), F.array_join("i.focus", " ").alias("focus"), "i.reason")


def followup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as follow-up questions with their words as options, cut to the caps."""
    turns = table(spark, sf_dir, "conversations")
    turns = ranked(turns, "conv_id", F.asc("turn"), k=opinions.MAX_QUESTIONS, rank="nth")
    q = F.struct(F.col("turn").alias("n"), F.when(F.col("turn") % 4 != 3, F.col("role")).alias("title"), F.lit("").alias("key"), words(F.col("text")).alias("options"))
    asked = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(q)).alias("qs")).select("conv_id", F.posexplode(opinions.followup(F.col("qs"))).alias("place", "q"))
    return asked.select("conv_id", "place", "q.title", "q.key", F.array_join("q.options", " ").alias("options"))


def questionnaire_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every option of a questionnaire: brands are modules, names questions, types options."""
    asked = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module"), F.col("p_name").alias("question")).agg(F.array_sort(F.collect_set("p_type")).alias("options"))
    return opinions.questionnaire(asked)


def questionnaire_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questionnaire_options(spark, sf_dir).select("module", "question").distinct()
    return rows.groupBy("module").agg(F.count("*").alias("questions"))


def consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each conversation; one in which a danger word falls stops early."""
    flags = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.contains(F.lower("text"), F.lit("the")), F.lit("the"))).alias("flags"))
    return consultation_events(flags.select(F.col("conv_id").alias("session_id"), "flags"))


def reassembled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cut anywhere into two buffers, read back stream by stream."""
    framed = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("stream"), "event_id", frame(F.col("event_type"), F.col("props")).alias("f"))
    cut = (F.col("event_id") % F.length("f")).cast("int")
    halves = framed.select("stream", F.explode(F.array(
        F.struct((F.col("event_id") * 2).alias("n"), F.substring("f", 1, cut).alias("t")), F.struct((F.col("event_id") * 2 + 1).alias("n"), F.substring("f", cut + 1, F.length("f")).alias("t")),
    )).alias("p")).select("stream", "p.n", "p.t")
    return reassembled(halves, "stream", "n", "t")


def reassembled_one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames in one stream, cut into buffers of 50 characters that don't heed them, read back by many tasks."""
    framed = table(spark, sf_dir, "events").select("event_id", frame(F.col("event_type"), F.col("props")).alias("f"))
    pieces = framed.select("event_id", F.posexplode(F.regexp_extract_all("f", F.lit(r"(?s).{1,50}"), 0)).alias("nth", "t"))
    return reassembled(pieces.select(F.lit("all").alias("stream"), F.struct("event_id", "nth").alias("n"), "t"), "stream", "n", "t")


def golden_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the results of hybrid search hold all or any of two phrases of the passage."""
    bag = words(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.array_join(F.slice(bag, 1, 2), " "), F.array_join(F.slice(bag, 3, 2), " ")).alias("phrases"))
    found = hybrid_search(spark, sf_dir).select("query_id", "doc_id").join(items, "query_id").join(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("content")), "doc_id")
    hit = lambda strict: evaluation.phrases_hit(F.col("content"), F.col("phrases"), strict)
    return found.select("query_id", "doc_id", hit(True).alias("strict"), hit(False).alias("loose"))


def encoder_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of vectors that find themselves first, and the least margin over the best other vector."""
    best = dense_top_k(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 2)
    return evaluation.self_check(best.withColumnRenamed("vec_id", "passage_id")).select(half_up(F.col("top1"), 6).alias("top1"), half_up(F.col("margin"), 6).alias("margin"))


def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of bytes, read back by format."""
    suffix = F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".epub")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), suffix).alias("name"), suffix.alias("suffix"), F.encode("text", "UTF-8").alias("content"))
    read = extracted(docs.withColumn("path", F.concat(F.lit("/in/"), "name")).select("path", "name", "suffix", "content"))
    rows = extraction_report(read).join(read.select("name", "digest", F.md5(F.col("text").cast("binary")).alias("text_digest")), "name")
    return rows.withColumn("density", half_up(F.col("density"), 3))


@F.pandas_udf(BinaryType())
def _book(kinds: pd.Series, titles: pd.Series, texts: pd.Series) -> pd.Series:
    make = {"epub": lambda title, text: epub_bytes(title, [text, "The end."]), "azw": palm_bytes, "txt": lambda title, text: text.encode()}
    return pd.Series([make[k](t, x) for k, t, x in zip(kinds, titles, texts, strict=True)])


def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as e-books, Palm books and plain files in one committed run, and read back by the same format."""
    kind = F.get(F.array(*(F.lit(k) for k in ("epub", "azw", "txt"))), F.pmod("doc_id", F.lit(3)).cast("int"))
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    root = f"{shared_dir(spark)}/lexmill/books-{uuid.uuid4().hex}"
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    write_files(docs, root, F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("kind")), _book("kind", title, "text"))
    read = books(read_committed(spark, root))
    sizes = written_list(spark, root).withColumn("filled", (F.col("size") > 0).cast("int")).select("folder", "name", "filled")
    trimmed = F.regexp_replace("text", r"^\s+|\s+\z", "")
    rows = read.join(sizes, ["folder", "name"]).select("folder", "name", "format", "title", "pages", F.md5(trimmed.cast("binary")).alias("digest"), F.size("notes").alias("notes"), "filled")
    found = stage(rows, "books")
    remove_committed(spark, root)
    return found


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with front matter written by school and slug, then those of English and French once more, and read back."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("school"), F.concat(F.lit("doc_"), "doc_id").alias("slug"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.lit("classic").alias("role"), "source", "text")
    root = f"{shared_dir(spark)}/lexmill/knowledge-{uuid.uuid4().hex}"
    write_documents(docs, root)
    write_documents(docs.filter(F.col("school").isin("en", "fr")).withColumn("role", F.lit("case")), root)
    found = stage(read_written(spark, root).select("school", "slug", F.md5(F.col("text").cast("binary")).alias("digest")), "knowledge")
    remove_committed(spark, root)
    return found


def known_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files in folders of schools, some of them unknown or no documents, read by school; `known` tells which are."""
    school = F.when(F.col("lang") == "en", "common").when(F.col("lang") == "fr", "piwei").otherwise(F.col("lang"))
    name = F.when(F.pmod("doc_id", F.lit(9)) == 0, F.concat(F.col("doc_id"), F.lit(".txt"))).otherwise(F.concat(F.col("doc_id"), F.lit(".md")))
    root = f"{shared_dir(spark)}/lexmill/folders-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents"), root, school, name, F.col("text"))
    run = current(*place(root))["runs"][0]
    good, unknown = read_documents(spark, f"{root}/{run}")
    rows = good.select("school", "source", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(True).alias("known"))
    found = stage(rows.unionByName(unknown.select("school", "source", F.lit("").alias("digest"), F.lit(False).alias("known"))), "folders")
    remove_committed(spark, root)
    return found


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints written as the state of a run and read back; a run over some schools only changes nothing."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "doc_id").alias("source"), F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    path = f"{shared_dir(spark)}/lexmill/state-{uuid.uuid4().hex}"
    write_state(docs, path, "v2", "hash@64")
    write_state(docs.filter("source like 'en%'"), path, "v3", "hash@64", whole=False)
    found = stage(read_state(spark, path).select("chunker", "space", "source", "fingerprint", F.col("updated").isNotNull().alias("dated")), "state")
    remove(spark, path)
    return found


def front_matter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of documents and what follows them."""
    raw = F.concat(F.lit("---\ntitle: A: b\nsource: "), "source", F.lit("\ntitle: "), "lang", F.lit("\nno pair\n---\n"), "text")
    meta, body = front_matter(raw)
    rows = table(spark, sf_dir, "documents").select("doc_id", meta.alias("m"), body.alias("body"))
    return rows.select("doc_id", F.element_at("m", "title").alias("title"), F.element_at("m", "source").alias("source"), F.size("m").alias("pairs"), F.md5(F.col("body").cast("binary")).alias("digest"))


def unified_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in odd quotes, line ends and blanks, with one kind of each."""
    odd = F.concat(F.lit("“\u200b"), F.regexp_replace("text", "\n", "\r\n\n\n"), F.lit("”\u3000 ‘x’ \t (汤 ，  「 好  」\r\n"))
    clean = squeeze_blank_lines(unify_punctuation(unify_lines(clean_markdown(odd))))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).alias("chars"), F.md5(clean.cast("binary")).alias("digest"))


def fitted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to five numbers and padded to a hundred, both of length 1."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", fit_dimension(F.col("embedding"), 5).alias("short"), fit_dimension(F.col("embedding"), 100).alias("long"))
    total = lambda c: half_up(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select("vec_id", F.size("short").alias("n_short"), total("short").alias("sum_short"), F.size("long").alias("n_long"), total("long").alias("sum_long"), half_up(F.element_at("long", 1), 6).alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        names, name_classes, source_expansion, manifest_rows, manifest_head, turn_frames, written_report, usage_counters, opinions_normalised, fact_lines, context_blocks, intake_rows, followup_questions,
        questionnaire_options, questionnaire_total, consultations, reassembled_frames, reassembled_one_stream, golden_hits, encoder_self_check, extracted_texts, book_files, knowledge_documents, known_folders, stored_state, front_matter_rows, unified_text, fitted_vectors,
    )
}

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
DOMAIN_SQL = ", ".join(f"'{d}'" for d in DOMAIN)
QUESTIONS = f"""
    q AS (SELECT p_brand AS module, p_name AS question, list_sort(list_distinct(list(p_type))) || ['{UNSURE}'] AS options FROM part GROUP BY ALL)"""

ORACLES = {
    "names": """
        SELECT c_custkey, c_name AS name, lower(trim(c_name || '@Example.ORG ')) AS address, sha256(c_name || chr(1) || c_custkey::VARCHAR) AS cache_key FROM customer""",
    "name_classes": """
        WITH n AS (SELECT doc_id, source || '-' || lang || '-' || doc_id::VARCHAR || ' (x)' AS name FROM documents),
        k AS (
            SELECT *, contains(name, 'src1') OR contains(name, 'src2') AS compendium,
                   CASE WHEN contains(name, '-fr-1') THEN 1 WHEN contains(name, '-de') THEN 2 WHEN regexp_matches(name, '-fr-[2-5]') THEN 3 WHEN contains(name, '-es-') THEN 4 ELSE 0 END AS which,
                   regexp_replace(substr(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), 1, 40), '^_+|_+$', '', 'g') AS made_slug, substr(trim(string_split(name, '(')[1]), 1, 60) AS made_title FROM n
        )
        SELECT doc_id, compendium, CASE which WHEN 1 THEN 'piwei' WHEN 2 THEN 'wenbing' WHEN 3 THEN 'huoshen' WHEN 4 THEN 'shanghan' ELSE '' END AS school,
               CASE which WHEN 1 THEN 'case' WHEN 2 THEN 'lecture' WHEN 3 THEN 'classic' WHEN 4 THEN 'case' ELSE '' END AS role,
               CASE which WHEN 0 THEN '' WHEN 1 THEN 'French ones' WHEN 2 THEN 'German' ELSE made_title END AS title,
               CASE which WHEN 0 THEN '' WHEN 1 THEN 'french_one' WHEN 2 THEN 'german' ELSE made_slug END AS slug,
               CASE which WHEN 0 THEN 0 WHEN 1 THEN 70 WHEN 2 THEN 60 ELSE 50 END AS priority, CASE WHEN which = 0 THEN '' WHEN which < 3 THEN 'registry' ELSE 'heuristic' END AS basis FROM k""",
    "source_expansion": f"""
        WITH n AS (SELECT doc_id, lang, source || '-' || (doc_id // 50)::VARCHAR AS grp, source || '-' || lang || '-' || doc_id::VARCHAR AS name, text, contains(source, 'src1') OR contains(source, 'src2') AS many FROM documents),
        single AS (
            SELECT *, CASE WHEN contains(name, '-fr-1') THEN 1 WHEN contains(name, '-de') THEN 2 WHEN regexp_matches(name, '-fr-[2-5]') THEN 3 WHEN regexp_matches(name, '-es-.*[05]$') THEN 4 ELSE 0 END AS which FROM n WHERE NOT many
        ),
        a AS (
            SELECT name AS source, CASE which WHEN 0 THEN '' WHEN 1 THEN 'French ones' WHEN 2 THEN 'German' ELSE name END AS unit, CASE which WHEN 0 THEN 'skipped' ELSE 'ready' END AS status,
                   CASE which WHEN 0 THEN 'not registered, and no pattern fits' ELSE '' END AS reason,
                   CASE which WHEN 1 THEN 'piwei' WHEN 2 THEN 'wenbing' WHEN 3 THEN 'huoshen' WHEN 4 THEN 'shanghan' ELSE '' END AS school,
                   CASE which WHEN 1 THEN 'case' WHEN 2 THEN 'lecture' WHEN 3 THEN 'classic' WHEN 4 THEN 'case' ELSE '' END AS role,
                   CASE which WHEN 0 THEN '' WHEN 1 THEN 'french_one' WHEN 2 THEN 'german' ELSE regexp_replace(substr(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), 1, 40), '^_+|_+$', '', 'g') END AS slug,
                   name AS cited, CASE which WHEN 0 THEN 0 ELSE length(text) END AS chars FROM single
        ),
        parts AS (
            SELECT grp, doc_id, lang, CASE lang WHEN 'en' THEN 'book en' WHEN 'de' THEN 'volume de' WHEN 'fr' THEN 'livre fr' WHEN 'es' THEN 'unknown es' ELSE 'none' END AS title,
                   CASE lang WHEN 'en' THEN '上' WHEN 'fr' THEN '下' ELSE '' END AS volume,
                   '{CIP}' || chr(10) || chr(10) || CASE lang WHEN 'en' THEN 'book en．上' WHEN 'de' THEN 'volume de' WHEN 'fr' THEN 'livre fr（下）' WHEN 'es' THEN 'unknown es' ELSE 'none' END
                   || '/x．-y：人民卫生出版社' || chr(10) || regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS body
            FROM n WHERE many
        ),
        sized AS (SELECT *, length(regexp_replace(body, '\\s+$', '')) AS size, count(*) OVER (PARTITION BY grp) AS imprints FROM parts),
        long AS (SELECT *, count(*) OVER (PARTITION BY grp) AS books FROM sized WHERE imprints > 1 AND size >= {LEAST}),
        b AS (
            SELECT grp AS source, title || CASE WHEN volume <> '' THEN '·' || volume ELSE '' END AS unit, CASE WHEN lang IN ('en', 'de', 'fr') THEN 'ready' ELSE 'skipped' END AS status,
                   CASE WHEN lang IN ('en', 'de', 'fr') THEN '' ELSE 'volume not registered' END AS reason, CASE lang WHEN 'en' THEN 'shanghan' WHEN 'de' THEN 'piwei' WHEN 'fr' THEN 'common' ELSE '' END AS school,
                   CASE lang WHEN 'en' THEN 'classic' WHEN 'de' THEN 'case' WHEN 'fr' THEN 'lecture' ELSE '' END AS role, CASE lang WHEN 'en' THEN 'book_en_shang' WHEN 'de' THEN 'volume_de' WHEN 'fr' THEN 'livre_fr_xia' ELSE '' END AS slug,
                   '{build.COMPENDIUM_LABEL}·' || title || CASE WHEN volume <> '' THEN '·' || volume ELSE '' END AS cited, CASE WHEN lang IN ('en', 'de', 'fr') THEN size ELSE 0 END AS chars,
                   CASE lang WHEN 'en' THEN 'book_en' WHEN 'de' THEN 'volume_de' WHEN 'fr' THEN 'livre_fr' ELSE '' END AS work FROM long WHERE books > 1
        ),
        c AS (SELECT DISTINCT grp AS source FROM parts WHERE grp NOT IN (SELECT source FROM b))
        SELECT source, unit, status, reason, school, role, slug, slug AS work, cited, chars::INT AS chars FROM a
        UNION ALL SELECT source, unit, status, reason, school, role, slug, work, cited, chars::INT FROM b
        UNION ALL SELECT source, '', 'skipped', 'a compendium without volumes', '', '', '', '', source, 0 FROM c""",
    "manifest_rows": """
        WITH d AS (SELECT *, 'Doc ' || doc_id::VARCHAR AS title FROM documents)
        SELECT 3 AS version, lang AS school, 'doc_' || doc_id::VARCHAR AS slug, source, title AS unit,
               md5(array_to_string(['---', 'title: ' || title, 'school: ' || lang, 'role: classic', 'source: ' || source, 'chars: ' || length(text)::VARCHAR, '---', '', text], chr(10))) AS digest,
               'classic' AS role, title, length(text)::BIGINT AS chars FROM d""",
    "manifest_head": "SELECT 3 AS version, count(*) AS documents, sum(length(text))::BIGINT AS chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS schools FROM documents",
    "turn_frames": """
        WITH j AS (SELECT conv_id, turn, role, to_json({'conv_id': conv_id, 'turn': turn, 'text': text})::VARCHAR AS data FROM conversations)
        SELECT conv_id, turn, md5('event: ' || role || chr(10) || 'data: ' || data || chr(10) || chr(10)) AS digest, length(data)::INT AS size FROM j""",
    "written_report": """
        WITH r AS (
            SELECT lang AS school, CASE doc_id % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'classic' ELSE 'other' END AS role, source || '-' || lpad(doc_id::VARCHAR, 9, '0') AS source, length(text) AS chunks FROM documents
        )
        SELECT school, CASE role WHEN 'classic' THEN 0 WHEN 'lecture' THEN 1 WHEN 'case' THEN 2 ELSE 9 END::INT AS role_rank, source,
               rpad(substr(source, 1, 34), 36, ' ') || ' ' || rpad(school, 12, ' ') || ' ' || rpad(role, 8, ' ') || ' ' || lpad(chunks::VARCHAR, 6, ' ') || ' ready' AS line, count(*) OVER (PARTITION BY school) AS documents FROM r""",
    "usage_counters": "SELECT source, count(*) AS texts, sum(length(text))::BIGINT AS tokens FROM documents GROUP BY source",
    "opinions_normalised": f"""
        SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '' END AS name, CASE WHEN turn % 2 = 0 AND text <> '' THEN text ELSE '{opinions.NO_DIAGNOSIS}' END AS diagnosis,
               least(1.0, turn / 4)::DOUBLE AS confidence, CASE turn % 3 WHEN 0 THEN role || chr(1) || text WHEN 1 THEN text ELSE '' END AS evidence, '' AS mechanism, role AS formula FROM conversations""",
    "fact_lines": f"""
        WITH l AS (SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY ALL),
        f AS (SELECT conv_id, string_agg('- ' || role || ': ' || text, chr(10) ORDER BY role) FILTER (text <> '' AND text <> '{UNSURE}') AS lines FROM l GROUP BY conv_id)
        SELECT conv_id, md5(coalesce(lines, '{opinions.NO_FACTS}')) AS digest, '证据不足，待进一步问诊' AS fallback FROM f""",
    "context_blocks": """
        WITH n AS (SELECT source, doc_id, lang, substr(text, 1, 900) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        r AS (SELECT *, sum(length(t)) OVER (PARTITION BY source ORDER BY i) AS used FROM n WHERE i <= 6),
        c AS (SELECT source, chr(10) || '【经典与医案参考】' || chr(10) || string_agg('[' || i::VARCHAR || '] （' || source || '·' || lang || '｜classic）' || t, chr(10) || '---' || chr(10) ORDER BY i) AS context FROM r WHERE used <= 3600 GROUP BY source)
        SELECT source, length(context)::INT AS chars, md5(context) AS digest FROM c""",
    "intake_rows": f"""
        SELECT conv_id, turn, md5(trim(text)) AS digest, CASE WHEN turn > 0 AND role IN ('shanghan', 'wenbing', 'piwei', 'system', 'user') THEN role ELSE 'integrative' END AS school,
               CASE WHEN turn > 0 THEN array_to_string({WORDS}[1:6], ' ') ELSE '' END AS clues,
               CASE WHEN turn > 0 THEN array_to_string(list_filter({WORDS}, lambda x: list_contains([{DOMAIN_SQL}], x))[1:4], ' ') ELSE '' END AS focus, CASE WHEN turn > 0 THEN '' ELSE '{opinions.INTAKE_REASON}' END AS reason FROM conversations""",
    "followup_questions": f"""
        WITH n AS (SELECT conv_id, turn, role, {WORDS} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS j FROM n WHERE i <= 3 AND turn % 4 <> 3)
        SELECT conv_id, (j - 1)::INT AS place, role AS title, 'q' || j::VARCHAR AS key, array_to_string((w || ['{UNSURE}'])[1:6], ' ') AS options FROM k""",
    "questionnaire_options": f"""
        WITH {QUESTIONS} SELECT module, question, (generate_subscripts(options, 1) - 1)::INT AS option_no, unnest(options) AS option FROM q""",
    "questionnaire_total": f"WITH {QUESTIONS} SELECT module, count(*) AS questions FROM q GROUP BY module",
    "consultations": """
        WITH c AS (SELECT conv_id, bool_or(contains(lower(text), 'the')) AS risky FROM conversations GROUP BY conv_id),
        e AS (SELECT conv_id, CASE WHEN risky THEN ['stage_started', 'risk_detected', 'completed'] ELSE ['stage_started', 'fact_proposed', 'agent_message', 'completed'] END AS e FROM c)
        SELECT conv_id AS session_id, (generate_subscripts(e, 1) - 1)::INT AS seq, unnest(e) AS event FROM e""",
    "reassembled_frames": """
        SELECT event_id % 97 AS stream, (row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) - 1)::INT AS event_no, event_type AS event, props AS data FROM events""",
    "reassembled_one_stream": """
        SELECT 'all' AS stream, (row_number() OVER (ORDER BY event_id) - 1)::INT AS event_no, event_type AS event, props AS data FROM events""",
    "extracted_texts": """
        WITH d AS (SELECT 'f' || doc_id::VARCHAR || CASE doc_id % 2 WHEN 0 THEN '.txt' ELSE '.epub' END AS name, text FROM documents)
        SELECT name, 'txt' AS format, length(text)::INT AS chars, 0 AS pages, floor(length(text) * 1000.0::DOUBLE + 0.5) / 1000 AS density, '' AS note, sha256(text) AS digest, md5(text) AS text_digest FROM d""",
    "book_files": r"""
        WITH d AS (SELECT *, doc_id % 3 AS k, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)
        SELECT lang AS folder, doc_id::VARCHAR || CASE k WHEN 0 THEN '.epub' WHEN 1 THEN '.azw' ELSE '.txt' END AS name, CASE k WHEN 0 THEN 'epub' WHEN 1 THEN 'mobi' ELSE 'txt' END AS format,
               CASE k WHEN 0 THEN 'Doc ' || doc_id::VARCHAR ELSE '' END AS title,
               CASE k WHEN 0 THEN 2 WHEN 1 THEN ((octet_length(encode(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'))) + 4095) // 4096)::INT ELSE 0 END AS pages,
               md5(CASE k WHEN 0 THEN t || chr(10) || chr(10) || 'The end.' ELSE t END) AS digest, 0 AS notes, 1 AS filled FROM d""",
    "knowledge_documents": """
        SELECT lang AS school, 'doc_' || doc_id::VARCHAR AS slug,
               md5('---' || chr(10) || 'title: Doc ' || doc_id::VARCHAR || chr(10) || 'school: ' || lang || chr(10) || 'role: ' || CASE WHEN lang IN ('en', 'fr') THEN 'case' ELSE 'classic' END || chr(10)
                   || 'source: ' || source || chr(10) || 'chars: ' || length(text)::VARCHAR || chr(10) || '---' || chr(10) || chr(10) || text) AS digest FROM documents""",
    "known_folders": """
        SELECT CASE lang WHEN 'en' THEN 'common' WHEN 'fr' THEN 'piwei' ELSE lang END AS school, doc_id::VARCHAR || '.md' AS source, CASE WHEN lang IN ('en', 'fr') THEN md5(text) ELSE '' END AS digest,
               lang IN ('en', 'fr') AS known FROM documents WHERE doc_id % 9 <> 0""",
    "stored_state": """
        SELECT 'v2' AS chunker, 'hash@64' AS space, lang || '/' || doc_id::VARCHAR AS source, md5(text) AS fingerprint, true AS dated FROM documents""",
    "front_matter_rows": """
        SELECT doc_id, lang AS title, source, 2 AS pairs, md5(text) AS digest FROM documents""",
    "unified_text": r"""
        WITH a AS (SELECT doc_id, '“' || chr(8203) || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(10)) || '”' || chr(12288) || ' ‘x’ ' || chr(9) || ' (汤 ，  「 好  」' || chr(13) || chr(10) AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '`{1,3}', '', 'g'), '(?m)^[ \t]*[-=]{3,}[ \t]*$', '', 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM a),
        c AS (SELECT doc_id, regexp_replace(replace(t, chr(8203), ''), '\r\n?', chr(10), 'g') AS t FROM b),
        e AS (SELECT doc_id, regexp_replace(translate(t, '“”‘’' || chr(12288) || '﹑‧', '「」『』 、·'), '[ \t]{2,}', ' ', 'g') AS t FROM c),
        f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([一-鿿])\s+([，。、；：！？）」』])', '\1\2', 'g'), '([（「『])\s+', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM e),
        g AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM f)
        SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM g""",
    "fitted_vectors": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e[1:5], lambda x: x * x))) AS short, sqrt(list_sum(list_transform(e[1:100], lambda x: x * x))) AS long FROM v)
        SELECT vec_id, 5 AS n_short, floor(list_sum(e[1:5]) / CASE WHEN short > 0 THEN short ELSE 1 END * 1e6 + 0.5) / 1e6 AS sum_short, 100 AS n_long,
               floor(list_sum(e[1:100]) / CASE WHEN long > 0 THEN long ELSE 1 END * 1e6 + 0.5) / 1e6 AS sum_long, floor(e[1] / CASE WHEN long > 0 THEN long ELSE 1 END * 1e6 + 0.5) / 1e6 AS first FROM n""",
    "encoder_self_check": """
        WITH p AS (SELECT q.vec_id AS q, e.vec_id AS v, floor(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS s FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0),
        t AS (SELECT q, max(s) FILTER (q = v) AS own, max(s) FILTER (q <> v) AS other FROM p GROUP BY q)
        SELECT floor(avg((own > other)::INT) * 1e6 + 0.5) / 1e6 AS top1, floor(min(own - other) * 1e6 + 0.5) / 1e6 AS margin FROM t""",
}


def _golden() -> str:
    """SQL of golden_hits() over the results of hybrid_search()."""
    from lexmill.plans.search import ORACLES as SEARCH

    return f"""
        WITH found AS ({SEARCH["hybrid_search"]}), b AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark),
        p AS (SELECT query_id, array_to_string(w[1:2], ' ') AS p1, array_to_string(w[3:4], ' ') AS p2 FROM b)
        SELECT query_id, doc_id, contains(lower(text), p1) AND contains(lower(text), p2) AS strict, contains(lower(text), p1) OR contains(lower(text), p2) AS loose
        FROM found JOIN p USING (query_id) JOIN documents USING (doc_id)"""


ORACLES["golden_hits"] = _golden()
