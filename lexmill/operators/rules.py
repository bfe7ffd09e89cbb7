"""Rules over facts: risk flags, scored candidates, panel merging, citations and context budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import words

# Terms, options, scores and answers of the rules.
DANGER_TERMS = ("胸痛", "呼吸困难", "意识不清", "大出血", "高热不退", "孕期出血")
PREGNANT, MINOR, CHRONIC = "孕产场景", "未成年人", "严重慢病"
UNSURE = "不确定"
COLD, TIRED, NO_APPETITE = ("经常怕冷",), ("容易疲倦",), ("食欲不振",)
HOT, THIRSTY = ("经常怕热", "手足心热"), ("口渴喜饮", "经常口渴")
YANG = ("脾胃阳虚倾向", 0.72, "温中健脾，调和营卫", "理中类方（仅供医师参考）")
QI = ("脾气不足倾向", 0.66, "健脾益气，改善运化", "四君子类方（仅供医师参考）")
HEAT = ("胃热倾向", 0.68, "清胃生津，和中护阴", "清胃类方（仅供医师参考）")
NOTHING = ("证据不足，待进一步问诊", 0.32, "暂不定治，补充四诊资料", None)
NO_FORMULA = "证据不足，暂不推荐具体方剂"
CONTEXT_CHARS, CONTEXT_ITEMS, ITEM_CHARS, CITATIONS = 3600, 6, 900, 4


def known_facts(facts: Column) -> Column:
    """Facts with a value that says something."""
    return F.map_filter(facts, lambda k, v: v.isNotNull() & (v != "") & (v != UNSURE))


def found_facts(turns: DataFrame, cues: DataFrame, session: str, turn: str, text: str) -> DataFrame:
    """(session, facts): what the words of each session's turns state, as a map, by cues of (key, cue, value).

    A cue is an ASCII word in lower case; a turn that holds it states the value. Of several statements of a key the one of
    the latest turn counts (turns without a number come first), in a turn the last word, then the larger value. Sessions
    that state nothing have an empty map; null and empty texts state nothing. Only the words that are cues pass the join,
    and they are reduced to one a key before the shuffle, so a session of any length is a row of at most as many facts as
    there are keys.
    """
    said = turns.select(F.col(session), F.col(turn).alias("turn"), F.posexplode(words(F.col(text))).alias("pos", "cue"))
    stated = said.join(cues.select("key", "cue", "value"), "cue")
    place = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "pos", "value")
    last = stated.groupBy(session, "key").agg(F.max(place)["value"].alias("value"))
    maps = last.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))
    every = turns.select(session).distinct()
    same = every[session].eqNullSafe(maps[session])
    return every.join(maps, same, "left").select(every[session], F.coalesce("facts", F.expr("map()").cast("map<string,string>")).alias("facts"))


def risk_flags(facts: Column, text: Column, terms: tuple[str, ...] = DANGER_TERMS) -> Column:
    """Sorted flags: terms found anywhere in the text, the keys or the values, and flags by single facts."""
    written = F.array_join(F.transform(F.map_entries(facts), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")
    hay = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(written, F.lit(""))))
    found = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(hay, F.lower(t)))
    fact = lambda k: F.lower(F.coalesce(F.try_element_at(facts, F.lit(k)), F.lit("")))
    single = F.array(
        F.when(fact("pregnant") == "true", PREGNANT),
        F.when(fact("age").try_cast("int") < 18, MINOR),
        F.when(~fact("serious_conditions").isin("", "false", "0"), CHRONIC),
    )
    return F.array_sort(F.array_distinct(F.concat(found, F.array_compact(single))))


def candidates(facts: Column) -> Column:
    """Scored candidates, best first; a statement of missing evidence where no rule fires."""
    fact = lambda k: F.coalesce(F.try_element_at(facts, F.lit(k)), F.lit(""))
    has = lambda k, options: fact(k).isin("true", *options)
    row = lambda r: F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(r, ("string", "double", "string", "string"), ("name", "score", "treatment", "formula"), strict=True)))
    cold, tired, hungry = has("cold", COLD), has("fatigue", TIRED), has("poor_appetite", NO_APPETITE)
    # written best first: the scores are fixed
    fired = F.array_compact(F.array(F.when(cold & tired, row(YANG)), F.when(has("heat", HOT) & has("thirst", THIRSTY), row(HEAT)), F.when(hungry & tired & ~cold, row(QI))))
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(row(NOTHING)))


def reports(sessions: DataFrame, overrides: DataFrame) -> DataFrame:
    """One report a session of (session_id, school, facts, text): best candidate, the school's own treatment, and no
    formula where anything is risky. `overrides` is a fixed small table (name, school, treatment, formula)."""
    top = sessions.select("session_id", "school", risk_flags(F.col("facts"), F.col("text")).alias("flags"), F.get(candidates(F.col("facts")), F.lit(0)).alias("top"))
    own = F.broadcast(overrides.select("name", "school", F.col("treatment").alias("own_treatment"), F.col("formula").alias("own_formula")))
    named = top.select("session_id", "school", "flags", "top.*").join(own, ["name", "school"], "left")
    formula = F.coalesce("own_formula", "formula", F.lit(NO_FORMULA))
    return named.select(
        "session_id", "school", F.col("name").alias("diagnosis"), F.col("score").alias("confidence"), F.coalesce("own_treatment", "treatment").alias("treatment"),
        F.when(F.size("flags") == 0, formula).alias("formula"), "flags",
    )


def merge_panel(opinions: DataFrame) -> DataFrame:
    """One row a session: the opinion of highest confidence (first in the panel's order on ties), and where it agrees."""
    best = Window.partitionBy("session_id").orderBy(F.desc("confidence"), F.asc("panel_no"))
    lead = opinions.withColumn("place", F.row_number().over(best)).filter("place = 1").select("session_id", F.col("diagnosis").alias("lead"), "confidence", F.col("school").alias("lead_school"))
    joined = opinions.select("session_id", "school", "diagnosis").join(lead, "session_id")
    names = lambda agree: F.array_join(F.array_sort(F.collect_list(F.when((F.col("diagnosis") == F.col("lead")) == agree, F.col("school")))), ",")
    return joined.groupBy("session_id", "lead", "lead_school", "confidence").agg(
        F.countDistinct("diagnosis").alias("diagnoses"), names(True).alias("consensus"), names(False).alias("divergence")
    )


def within_budget(items: DataFrame, group: str, order: Column, size: Column) -> DataFrame:
    """The first items of each group, cut to 900 characters, up to the first that would pass 3600 characters."""
    first = items.withColumn("item", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("item") <= CONTEXT_ITEMS)
    cut = first.withColumn("used", F.least(size, F.lit(ITEM_CHARS)))
    running = F.sum("used").over(Window.partitionBy(group).orderBy("item"))
    return cut.withColumn("total", running).filter(F.col("total") <= CONTEXT_CHARS)


def distinct_citations(items: DataFrame, group: str, label: str, order: str, most: int = CITATIONS) -> DataFrame:
    """The first `most` different labels of each group, by first appearance."""
    first = items.groupBy(group, label).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("first", label))).filter(F.col("place") <= most)
