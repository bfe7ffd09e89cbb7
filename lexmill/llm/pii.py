"""Operator 11: personal data, and the terms that give it away, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import let, scan
from lexmill.llm.common import free_name, join_groups
from lexmill.session import stage

# The base patterns in forms without repeated groups (which Java matches by recursion) and without a second try inside a
# run, so that long runs cost what they are long. They match the same spans:
# an e-mail begins where its run of local characters does, or where the last match ended; its domain runs on while a
# letter, digit or hyphen follows, or a dot with one behind it. A card runs on while a digit follows, or one separator
# with a digit behind it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?![0-9]|[ -][0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: A term: letters, three at least, between blanks, with punctuation around them or not.
TERM = r"(?<=[\s(\[\"'«„“])[\p{L}\p{M}]{3,}+(?=[.,;:!?)\]\"'»”]*+\s)"
#: Code points on either side of an entity that count as its context.
WINDOW = 160
#: Terms that the context of one entity can hold at most: four code points each, blank included, on both sides.
CONTEXT_TERMS = 2 * WINDOW // 4
#: A pair is judged when the term stands in so many different contexts of the entity.
CONTEXTS = 3
#: A term discloses an entity when their mutual information is at least this share of the entity's information.
DISCLOSURE = 0.9
#: Letters that the generalised form of a term keeps.
STEM = 3
STEP = 512


def running(lengths: Column) -> Column:
    """Sum of all earlier items for each item of an array of longs, slice by slice, so that long arrays cost in proportion."""
    none = F.array().cast("array<bigint>")
    state = lambda out, at: F.struct(out.alias("out"), at.alias("at"))
    add = lambda acc, x: state(F.concat(acc["out"], F.array(acc["at"])), acc["at"] + x)
    begin = state(none, F.lit(0).cast("long"))
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.aggregate(F.slice(lengths, i + 1, STEP), begin, add))

    def whole(parts: Column) -> Column:
        offsets = F.aggregate(parts, begin, lambda acc, p: add(acc, p["at"]))["out"]
        return F.flatten(F.zip_with(offsets, parts, lambda o, p: F.transform(p["out"], lambda x: x + o)))

    return let(parts, whole)


def matched(text: Column, pattern: str, of: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """Array of of(start, end, value, text before, text after) for the leftmost matches that don't overlap; the texts reach
    to the neighbouring matches. Places are code points, the end is exclusive."""

    def placed(pieces: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, i: (F.length(F.get(pieces, i)) + F.length(v)).cast("long"))

        def one(starts: Column) -> Column:
            def of_match(value: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(F.get(pieces, i))
                return of(start, start + F.length(value), value, F.get(pieces, i), F.get(pieces, i + 1))

            return F.transform(values, of_match)

        return let(running(lengths), one)

    return let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda values: placed(pieces, values)))


def _ip(value: Column) -> Column:
    small = lambda z: F.when(F.length(z) <= 3, F.concat(F.lit("0"), z).cast("int") <= 255).otherwise(F.lit(False))
    return F.forall(F.split(value, r"\."), lambda part: small(F.ltrim(part, F.lit("0"))))


def _luhn(digits: Column) -> Column:
    """The checksum from the right: every second digit doubled, nine off what exceeds nine."""
    double = lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int")
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), double), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))


def _phone(value: Column) -> Column:
    return F.length(F.translate(value, "+ ().-", "")).between(9, 15)


#: Base kinds in the order of the spans: name, pattern, what a text must hold to be searched, test of a match, entity of a match.
KINDS = (
    ("email", EMAIL, lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), F.lower),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip, lambda v: v),
    ("card", CARD, lambda t: t.rlike("[0-9][ -]?[0-9]"), _card, lambda v: F.translate(v, " -", "")),
    ("phone", PHONE, lambda t: F.contains(t, F.lit("+")), _phone, lambda v: F.translate(v, "+ ().-", "")),
)
NAMES = [*(k[0] for k in KINDS), "term"]
HIT = "start bigint, kind int, end bigint, value string, before string, after string, first boolean, last boolean"


def hits(text: Column) -> Column:
    """Array of the base kinds' spans with their contexts, by start, then kind.

    first and last tell whether a context reaches to the beginning or end of the text.
    """
    return let(F.length(text), lambda size: _hits(text, size))


def _hits(text: Column, size: Column) -> Column:
    out = []
    for number, (_, pattern, gate, holds, entity) in enumerate(KINDS):

        def of(start, end, value, before, after, number=number, holds=holds, entity=entity):
            near, far = F.right(before, F.lit(WINDOW)), F.left(after, F.lit(WINDOW))
            return F.struct(
                start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), entity(value).alias("value"), near.alias("before"), far.alias("after"),
                (start == F.length(near)).alias("first"), (end + F.length(far) == size).alias("last"), holds(value).alias("holds"),
            )

        none = F.array().cast(f"array<struct<{HIT}, holds boolean>>")
        found = F.filter(matched(text, pattern, of), lambda h: h["holds"])
        out.append(F.transform(F.when(gate(text), found).otherwise(none), lambda h: F.struct(*(h[c.split()[0]].alias(c.split()[0]) for c in HIT.split(", ")))))
    return F.sort_array(F.concat(*out))


def stem(term: Column) -> Column:
    """What a term is generalised to: its first letters and a star."""
    return F.concat(F.left(term, F.lit(STEM)), F.lit("*"))


def occurrences(found: DataFrame) -> DataFrame:
    """(uid, kind, value, context, term, start, end): the terms around each entity, lower-cased.

    A term lies whole in its context, so its place there is its place in the text; it can't overlap a base span, as those
    have no letters between blanks.
    """
    h = F.col("h")
    place = lambda offset: lambda start, end, value, *_: F.struct(F.lower(value).alias("term"), (offset + start).alias("start"), (offset + end).alias("end"))
    left, right = F.when(h["first"], F.lit(" ")).otherwise(""), F.when(h["last"], F.lit(" ")).otherwise("")
    before = matched(F.concat(left, h["before"]), TERM, place(h["start"] - F.length(h["before"]) - F.length(left)))
    after = matched(F.concat(h["after"], right), TERM, place(h["end"]))
    spread = found.select("uid", F.explode("hits").alias("h"))
    return spread.select("uid", h["kind"].alias("kind"), h["value"].alias("value"), F.xxhash64(F.lower(h["before"]), F.lower(h["after"])).alias("context"), F.explode(F.concat(before, after)).alias("t")).select(
        "uid", "kind", "value", "context", "t.term", "t.start", "t.end"
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term, and each generalised form, over whole texts."""
    terms = F.transform(F.regexp_extract_all(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.lit(TERM), 0), F.lower)
    each = let(F.array_distinct(terms), lambda t: F.concat(t, F.array_distinct(F.transform(t, stem))))
    return docs.filter(F.col("text").isNotNull()).select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def disclosing(docs: DataFrame, found: DataFrame, total: int, contexts: int = CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(kind, value, term, joint, general): terms that disclose an entity, and the form that doesn't, if there is one.

    With n documents, an entity c in df(c) of them has -log(df(c)/n) of information. A term t, in df(t) documents and
    near c in df(c,t), gives log(n df(c,t) / (df(c) df(t))) of it away. Terms that give `disclosure` of it are flagged if
    they stand in at least `contexts` different contexts of c: one context, however often it is copied, is no evidence.
    The same is asked of the generalised form, which counts all terms that share it.
    """
    near = occurrences(found).select("uid", "kind", "value", "context", "term")
    both = near.unionByName(near.withColumn("term", stem(F.col("term"))))
    joint = both.groupBy("kind", "value", "term").agg(F.count_distinct("uid").alias("joint"), F.count_distinct("context").alias("contexts")).filter(F.col("contexts") >= contexts)
    entities = found.select("uid", F.explode("hits").alias("h")).groupBy(F.col("h.kind").alias("kind"), F.col("h.value").alias("value")).agg(F.count_distinct("uid").alias("of_entity"))
    n = F.lit(float(total))
    known = n / F.col("of_entity")
    given = F.col("joint") * n / (F.col("of_entity") * F.col("df"))
    share = F.when(F.col("of_entity") < n, F.ln(given) / F.ln(known)).otherwise(0.0)
    # slack for the last bits of the logarithms
    judged = joint.join(entities, ["kind", "value"]).join(term_counts(docs), "term").withColumn("tells", share >= disclosure - 1e-9)
    judged = stage(judged.select("kind", "value", "term", "joint", "tells"), "disclosure")
    quiet = judged.filter(~F.col("tells") & F.endswith("term", F.lit("*"))).select("kind", "value", F.col("term").alias("general"))
    loud = judged.filter(F.col("tells") & ~F.endswith("term", F.lit("*"))).withColumn("form", stem(F.col("term")))
    return stage(loud.join(quiet.withColumn("form", F.col("general")), ["kind", "value", "form"], "left").select("kind", "value", "term", "joint", "general"), "disclosing")


def found_spans(docs: DataFrame, mark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, added): rows with uid and base hits, written, and for each uid the method's spans as an array of
    (start, kind, end, general), general being null where a term goes altogether. Given a `mark`, rows keep all columns of
    the input and have uid and hits in a struct of that name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if mark:
        kept = stage(docs.withColumn(mark, F.struct(F.monotonically_increasing_id().alias("uid"), hits(text).alias("hits"))), "spans")
        found = kept.select(F.col(mark)["uid"].alias("uid"), F.col(mark)["hits"].alias("hits"))
    else:
        kept = found = stage(docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), hits(text).alias("hits")), "spans")
    total, entities = found.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    flagged = disclosing(docs.select("text"), found, total)
    # an entity has CONTEXT_TERMS terms around it at most, so fewer than 1000 pairs are hot
    places = join_groups(occurrences(found).drop("context"), flagged, ["kind", "value", "term"], "joint", entities * CONTEXT_TERMS)
    once = places.groupBy("uid", "start", "end").agg(F.bool_and(F.col("general").isNotNull()).alias("keeps"), F.min("general").alias("general"))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", F.when(F.col("keeps"), F.col("general")).alias("general"))
    return kept, once.groupBy("uid").agg(F.collect_list(span).alias("added"))


def all_spans(hits: Column, added: Column) -> Column:
    """Base spans and the method's, by start, then kind."""
    bare = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), h["end"].alias("end"), F.lit(None).cast("string").alias("general")))
    return F.sort_array(F.concat(bare, F.coalesce(added, F.array().cast("array<struct<start bigint, kind int, end bigint, general string>>"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of personal data for each document, with the number of terms added.

    Base spans are e-mail and IP addresses, card and phone numbers, leftmost and without overlap within a kind; matches
    that fail their test are dropped. The method adds `term` spans: words near an entity that disclose it, judged over all
    documents and marked in the documents that hold the entity; documents without personal data get none. Null and empty
    texts have no spans. Repeated rows and null ids get rows of their own and count as documents. Empty table: no rows.
    Other columns of the input are not read.
    """
    rows, added = found_spans(docs.select("doc_id", "text"))
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count_of = lambda k: F.size(F.filter("hits", lambda h: h["kind"] == k)).cast("long")
    joined = rows.select("doc_id", "uid", F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), h["end"].alias("end"))).alias("hits")).join(added, "uid", "left")
    return joined.select(
        "doc_id", *(count_of(k).alias(f"n_{name}") for k, name in enumerate(NAMES[:-1])), F.sha2(shown(F.col("hits")).cast("binary"), 256).alias("base_sha256"),
        shown(all_spans(F.col("hits"), F.col("added"))).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced, all their columns kept, whatever their names.

    Base spans become [EMAIL], [IP], [CARD] or [PHONE]; disclosing terms become their generalised form where that doesn't
    disclose the entity any more, else [TERM]. Overlapping spans are replaced together by the mark of the first.
    Null texts stay null, texts without spans stay as they are.
    """
    mark = free_name(docs, "spans")
    rows, added = found_spans(docs, mark)
    rows = rows.join(added.select(F.struct("uid", "added").alias(f"{mark}_")), F.col(mark)["uid"] == F.col(f"{mark}_")["uid"], "left")
    labels = F.array(*(F.lit(f"[{n.upper()}]") for n in NAMES))

    def replaced(chars: Column) -> Column:
        return let(all_spans(F.col(mark)["hits"], F.col(f"{mark}_")["added"]), lambda spans: joined(chars, spans))

    def joined(chars: Column, spans: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")

        def step(open_: Column, span: Column) -> tuple[Column, dict[str, Column]]:
            word = F.concat(cut(open_["at"], span["start"]), F.coalesce(span["general"], F.get(labels, span["kind"])))
            out = F.when(span["start"] >= open_["at"], F.array(word)).otherwise(F.array().cast("array<string>"))
            return out, {"at": F.greatest(open_["at"], span["end"])}

        return F.array_join(scan(spans, {"at": F.lit(0).cast("long")}, step, lambda acc: F.array(cut(acc["at"], F.size(chars).cast("long")))), "")

    touched = F.size(F.col(mark)["hits"]) > 0
    text = F.when(touched, let(F.split("text", ""), replaced)).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
