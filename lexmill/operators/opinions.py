"""Opinions, prompts and questionnaires as columns: coercion of replies, fall-backs, formatted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import clamp, label
from lexmill.operators.retrieval import ranked
from lexmill.operators.rules import CONTEXT_CHARS, CONTEXT_ITEMS, ITEM_CHARS, UNSURE, candidates

# Words and limits of the opinions.
NO_DIAGNOSIS, NO_FACTS = "信息不足", "（患者尚未提供有效信息）"
FALLBACK_MECHANISM = "基于结构化四诊的证素归纳，为规则引擎给出的倾向性判断（未接入大模型）。"
FALLBACK_DIFFERENCE = "证据有限，建议补充舌脉与专科信息。"
INTAKE_REASON, INTAKE_SCHOOL = "暂无法智能解析，已为您选择兼容各家的汇通医家", "integrative"
CONTEXT_HEAD = "\n【经典与医案参考】\n"
MAX_FOCUS, MAX_CLUES, MAX_QUESTIONS, MAX_OPTIONS = 4, 6, 3, 6


def as_list(value: Column) -> Column:
    """Strings of a variant: a list's items, one item for a text that isn't empty, else none."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    return F.coalesce(F.when(kind.startswith("ARRAY"), listed).when((kind == "STRING") & (text != ""), F.array(text)), F.array().cast("array<string>"))


def opinion(reply: Column) -> Column:
    """Typed struct of a JSON reply: defaults for what is missing, confidence within 0 and 1, lists from texts. A reply that
    is no JSON gives the defaults."""
    whole = F.try_parse_json(reply)
    text = lambda k, default="": F.coalesce(F.nullif(F.try_variant_get(whole, f"$.{k}", "string"), F.lit("")), F.lit(default))
    part = lambda k: F.try_variant_get(whole, f"$.{k}", "variant")
    return F.struct(
        text("diagnosis", NO_DIAGNOSIS).alias("diagnosis"), clamp(F.try_variant_get(whole, "$.confidence", "string"), 0.5).alias("confidence"),
        as_list(part("evidence")).alias("evidence"), as_list(part("counter")).alias("counter"),
        text("mechanism").alias("mechanism"), text("treatment").alias("treatment"), F.nullif(text("formula"), F.lit("")).alias("formula"), text("differentiation").alias("differentiation"),
    )


def with_profile(opinions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Opinions with the name and title of their school; `profiles` (school, name, title) is a fixed small table."""
    return opinions.join(F.broadcast(profiles), "school", "left")


def facts_text(facts: Column) -> Column:
    """One line a fact that says something, in the order of the keys."""
    entries = F.filter(F.array_sort(F.map_entries(facts)), lambda e: e["value"].isNotNull() & (e["value"] != "") & (e["value"] != UNSURE))
    lines = F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_FACTS))


def fallback_opinion(facts: Column) -> Column:
    """Opinion by the rules alone."""
    top = F.get(candidates(facts), F.lit(0))
    entries = F.filter(F.array_sort(F.map_entries(facts)), lambda e: e["value"].isNotNull() & (e["value"] != "") & (e["value"] != UNSURE))
    return F.struct(
        top["name"].alias("diagnosis"), top["score"].alias("confidence"), F.transform(entries, lambda e: F.concat(e["key"], F.lit("："), e["value"])).alias("evidence"),
        F.array().cast("array<string>").alias("counter"), F.lit(FALLBACK_MECHANISM).alias("mechanism"), top["treatment"].alias("treatment"), top["formula"].alias("formula"),
        F.lit(FALLBACK_DIFFERENCE).alias("differentiation"),
    )


def intake(complaint: Column, school: Column, schools: list[str], clues: Column, focus: Column, domain: list[str]) -> Column:
    """What an intake says: known school or the integrative one, at most six clues, at most four known modules. A null
    school stands for a reply that failed: then the complaint alone is kept, with the reason."""
    ok = school.isNotNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.trim(F.coalesce(complaint, F.lit(""))).alias("summary"), F.when(ok & school.isin(*schools), school).otherwise(F.lit(INTAKE_SCHOOL)).alias("school"),
        F.when(ok, F.slice(clues, 1, MAX_CLUES)).otherwise(none).alias("clues"), F.when(ok, F.slice(F.filter(focus, lambda m: m.isin(*domain)), 1, MAX_FOCUS)).otherwise(none).alias("focus"),
        F.when(ok, F.lit("")).otherwise(F.lit(INTAKE_REASON)).alias("reason"),
    )


def followup(questions: Column) -> Column:
    """At most three questions of (title, key, options) with a title, each with at most six options of which one is unsure."""
    first = F.filter(F.slice(questions, 1, MAX_QUESTIONS), lambda q: F.coalesce(q["title"], F.lit("")) != "")
    return F.transform(first, lambda q, i: F.struct(
        q["title"].alias("title"), F.coalesce(F.nullif(q["key"], F.lit("")), F.concat(F.lit("q"), (i + 1).cast("string"))).alias("key"),
        F.slice(with_unsure(q["options"]), 1, MAX_OPTIONS).alias("options"),
    ))


def with_unsure(options: Column) -> Column:
    return F.when(F.array_contains(options, UNSURE), options).otherwise(F.array_append(options, F.lit(UNSURE)))


def context_text(items: DataFrame, group: str, order: str, role: Column) -> DataFrame:
    """(group, context): the first items of (title, section, content), numbered and labelled, up to the budget of characters."""
    cut = F.substring("content", 1, ITEM_CHARS)
    few = ranked(items, group, F.asc(order), k=CONTEXT_ITEMS, rank="nth")
    each = few.select(group, F.struct("nth", label(F.col("title"), F.col("section")).alias("label"), role.alias("role"), cut.alias("text")).alias("i"))
    first = each.groupBy(group).agg(F.array_sort(F.collect_list("i")).alias("items"))
    used = lambda n: F.aggregate(F.slice("items", 1, n + 1), F.lit(0), lambda a, x: a + F.length(x["text"]))
    # items before the first that passes the budget; sums only grow, so these are those whose own sum is within it
    kept = first.select(group, F.filter("items", lambda x, n: used(n) <= CONTEXT_CHARS).alias("items"))
    lines = F.transform("items", lambda x, n: F.concat(F.lit("["), (n + 1).cast("string"), F.lit("] （"), x["label"], F.lit("｜"), x["role"], F.lit("）"), x["text"]))
    return kept.select(group, F.when(F.size("items") > 0, F.concat(F.lit(CONTEXT_HEAD), F.array_join(lines, "\n---\n"))).otherwise("").alias("context"))


def questionnaire(questions: DataFrame) -> DataFrame:
    """(module, question, option_no, option): every option of every question, the unsure one put last where it lacks."""
    return questions.select("module", "question", F.posexplode(with_unsure(F.col("options"))).alias("option_no", "option"))
