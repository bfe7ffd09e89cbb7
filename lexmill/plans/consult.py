"""Rule, panel, conversation and event queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import clamp, half_up, json_object, mask_secret
from lexmill.operators import rules
from lexmill.operators.panel_values import OVERRIDES, SCHOOLS
from lexmill.operators.retrieval import ranked
from lexmill.plans.search import table
from lexmill.streaming.ingest import frame, report_events, unframe

#: Words of the tables' invented talk that stand for answers: (key, word, value). Of a key's words in a conversation the last counts.
CUES = (
    ("cold", "ing", "经常怕冷"), ("cold", "erer", "true"), ("cold", "thnd", "没有怕冷"), ("cold", "enst", "经常怕冷"), ("cold", "des", "不确定"),
    ("fatigue", "than", "容易疲倦"), ("fatigue", "ble", "精力充沛"), ("fatigue", "ch", "容易疲倦"), ("fatigue", "er", "true"),
    ("poor_appetite", "thou", "食欲不振"), ("poor_appetite", "nd", "正常"), ("poor_appetite", "au", "食欲不振"), ("poor_appetite", "of", "不确定"),
    ("heat", "heat", "经常怕热"), ("heat", "thing", "手足心热"), ("heat", "wh", "没有怕热"), ("heat", "only", "没有怕热"), ("heat", "ie", "手足心热"),
    ("thirst", "then", "口渴喜饮"), ("thirst", "sh", "不渴"), ("thirst", "thin", "经常口渴"), ("thirst", "en", "口渴喜饮"),
    ("age", "rest", "12"), ("age", "that", "64"), ("age", "ly", "17"), ("age", "un", "40"), ("age", "ones", "unknown"),
    ("pregnant", "onth", "true"), ("pregnant", "hare", "false"), ("pregnant", "ung", "false"),
    ("serious_conditions", "anly", "胸痛"), ("serious_conditions", "aned", "yes"), ("serious_conditions", "rees", "false"), ("serious_conditions", "anor", "0"),
)
TERMS = ("idiot", "worthless", "the")
#: Characters of a reply from which it counts as a view of its own.
SECOND_VIEW = 1500


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session a conversation: the facts that its words state, and the user's last text."""
    turns = table(spark, sf_dir, "conversations")
    cues = spark.createDataFrame(CUES, "key string, cue string, value string")
    facts = rules.found_facts(turns, cues, "conv_id", "turn", "text")
    last = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return facts.join(last, "conv_id", "left").withColumnRenamed("conv_id", "session_id")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, panel_no, reply): the first replies of each conversation, one a school in the panel's order."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    first = ranked(said, "conv_id", F.asc("turn"), k=len(SCHOOLS), rank="nth")
    return first.select(F.col("conv_id").alias("session_id"), (F.col("nth") - 1).cast("int").alias("panel_no"), F.col("text").alias("reply"))


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "name string, school string, treatment string, formula string")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session before every school, in the panel's order."""
    order = F.posexplode(F.array(*(F.lit(s) for s in SCHOOLS))).alias("panel_no", "school")
    return sessions(spark, sf_dir).select("session_id", "facts", "text", order)


def joined(flags: Column) -> Column:
    return F.array_join(flags, ",")


def risk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each conversation turn by a list of terms of its own."""
    turns = table(spark, sf_dir, "conversations")
    facts = F.create_map(F.lit("role"), F.col("role"))
    return turns.select("conv_id", "turn", joined(rules.risk_flags(facts, F.col("text"), TERMS)).alias("flags"))


def fact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("session_id", joined(rules.risk_flags(F.col("facts"), F.col("text"))).alias("flags"), F.size(rules.known_facts(F.col("facts"))).alias("known"))


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(spark, sf_dir).select("session_id", F.posexplode(rules.candidates(F.col("facts"))).alias("place", "c"))
    return found.select("session_id", "place", F.col("c.name").alias("name"), F.col("c.score").alias("score"))


def panel_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules.reports(panel(spark, sf_dir), overrides(spark)).withColumn("flags", joined(F.col("flags")))
    return done.fillna({"formula": ""})


def panel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel opinions merged by session. A school's opinion is as confident as its reply has lines; a reply that says much
    is a second view."""
    order = F.array_position(F.array(*(F.lit(s) for s in SCHOOLS)), F.col("school")).cast("int") - 1
    opinions = rules.reports(panel(spark, sf_dir), overrides(spark)).withColumn("panel_no", order).join(replies(spark, sf_dir), ["session_id", "panel_no"], "left")
    own = F.col("confidence") + F.lit(0.01) * F.least(F.coalesce(F.size(F.split("reply", "\n")), F.lit(0)), F.lit(6))
    second = F.length("reply") > SECOND_VIEW
    return rules.merge_panel(opinions.withColumns({"diagnosis": F.when(second, "second view").otherwise(F.col("diagnosis")), "confidence": own}))


def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last words of each role in a conversation: later turns overwrite earlier ones."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"), F.count("*").alias("turns"))
    return last.select("conv_id", "role", "turn", "turns", F.md5(F.col("text").cast("binary")).alias("digest"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("size"))
    return rules.within_budget(items, "source", F.asc("doc_id"), F.col("size")).select("source", "item", "doc_id", "used", "total")


def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.distinct_citations(table(spark, sf_dir, "documents"), "source", "lang", "doc_id").select("source", "lang", "first", "place")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One server-sent frame an event."""
    return table(spark, sf_dir, "events").select("event_id", frame(F.col("event_type"), F.col("props")).alias("frame"))


def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read back: the name and the number in each event's data."""
    back = event_frames(spark, sf_dir).select("event_id", F.get(unframe(F.col("frame")), F.lit(0)).alias("f"))
    return back.select("event_id", F.col("f.event").alias("event"), F.from_json("f.data", "k long")["k"].alias("k"))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found in replies, clamped to 0 and 1 and averaged."""
    reply = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" end"))
    value = clamp(F.get_json_object(json_object(reply), "$.k").cast("double") / 100, 0.5)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(half_up(F.avg(value), 6).alias("score"), F.count("*").alias("n"))


def report_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report's stream tells. An opinion rests on its school's reply, else on the rules; a session all of whose
    opinions fell back to the rules ends with an error."""
    opinions = panel(spark, sf_dir).select("session_id", "panel_no").join(replies(spark, sf_dir), ["session_id", "panel_no"], "left")
    ended = opinions.groupBy("session_id").agg(F.count("*").cast("int").alias("agents"), (F.count("reply") == 0).alias("failed"))
    flagged = sessions(spark, sf_dir).select("session_id", rules.risk_flags(F.col("facts"), F.col("text")).alias("flags"))
    return report_events(flagged.join(ended, "session_id"))


def masked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask_secret(F.col("c_name")).alias("masked"))


QUERIES = {
    f.__name__: f
    for f in (
        risk_scan, fact_flags, rule_scores, panel_reports, panel_merge, session_state, context_budget, citation_dedup, event_frames, frame_round_trip, event_scores,
        report_sequence, masked_keys,
    )
}

CUE_ROWS = ", ".join(str(c) for c in CUES)
TOP = "top AS (SELECT session_id, arg_max(name, score) AS name, max(score) AS score FROM scored GROUP BY ALL)"
PANEL = "panel(school, panel_no) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(SCHOOLS)) + ")"
HAS = "max(CASE WHEN k = '{0}' AND v IN ({1}, 'true') THEN 1 ELSE 0 END) = 1"
SCORED = f"""
    cue(k, word, v) AS (VALUES {CUE_ROWS}),
    bags AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM conversations),
    said AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM bags),
    f AS (
        SELECT conv_id AS session_id, k, arg_max(v, turn * 1000000 + pos) AS v FROM said JOIN cue USING (word) GROUP BY ALL
        UNION ALL SELECT conv_id, '', coalesce(arg_max(text, turn) FILTER (role = 'user'), '') FROM conversations GROUP BY ALL
    ),
    reply AS (
        SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS panel_no, text AS reply FROM conversations WHERE role = 'assistant'
    ),
    has AS (
        SELECT session_id, {HAS.format("cold", "'经常怕冷'")} AS cold, {HAS.format("fatigue", "'容易疲倦'")} AS tired, {HAS.format("poor_appetite", "'食欲不振'")} AS hungry,
               {HAS.format("heat", "'经常怕热', '手足心热'")} AS heat, {HAS.format("thirst", "'口渴喜饮', '经常口渴'")} AS thirst FROM f GROUP BY session_id
    ),
    fired AS (
        SELECT session_id, '脾胃阳虚倾向' AS name, 0.72::DOUBLE AS score FROM has WHERE cold AND tired
        UNION ALL SELECT session_id, '胃热倾向', 0.68 FROM has WHERE heat AND thirst
        UNION ALL SELECT session_id, '脾气不足倾向', 0.66 FROM has WHERE hungry AND tired AND NOT cold
    ),
    scored AS (
        SELECT * FROM fired UNION ALL SELECT session_id, '证据不足，待进一步问诊', 0.32 FROM has WHERE session_id NOT IN (SELECT session_id FROM fired)
    ),
    flags AS (
        SELECT session_id, list_sort(list_distinct(list(flag) FILTER (flag IS NOT NULL))) AS flags FROM (
            SELECT session_id, CASE WHEN k = 'pregnant' AND v = 'true' THEN '孕产场景' WHEN k = 'age' AND try_cast(v AS INT) < 18 THEN '未成年人'
                   WHEN k = 'serious_conditions' AND v NOT IN ('', 'false', '0') THEN '严重慢病' END AS flag FROM f
            UNION ALL SELECT session_id, t FROM f CROSS JOIN (VALUES ('胸痛'), ('呼吸困难'), ('意识不清'), ('大出血'), ('高热不退'), ('孕期出血')) AS terms(t) WHERE contains(k || v, t)
        ) GROUP BY session_id
    )"""

ORACLES = {
    "risk_scan": """
        SELECT conv_id, turn, array_to_string(list_sort(list_filter(['idiot', 'worthless', 'the'], lambda t: contains(lower(text || ' role: ' || role), t))), ',') AS flags FROM conversations""",
    "fact_flags": f"""
        WITH {SCORED}, known AS (SELECT session_id, count(*) FILTER (k <> '' AND v NOT IN ('', '不确定')) AS known FROM f GROUP BY ALL)
        SELECT session_id, coalesce(array_to_string(flags, ','), '') AS flags, known::INT AS known FROM flags JOIN known USING (session_id)""",
    "rule_scores": f"WITH {SCORED} SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY score DESC) - 1)::INT AS place, name, score FROM scored",
    "session_state": """
        SELECT conv_id, role, max(turn) AS turn, count(*) AS turns, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id, role""",
    "context_budget": """
        WITH n AS (SELECT source, doc_id, least(length(text), 900)::INT AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS item FROM documents),
        r AS (SELECT *, sum(used) OVER (PARTITION BY source ORDER BY item)::BIGINT AS total FROM n WHERE item <= 6)
        SELECT source, item::INT AS item, doc_id, used, total FROM r WHERE total <= 3600""",
    "citation_dedup": """
        WITH f AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL)
        SELECT * FROM (SELECT source, lang, first, row_number() OVER (PARTITION BY source ORDER BY first, lang)::INT AS place FROM f) WHERE place <= 4""",
    "event_frames": "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events",
    "frame_round_trip": "SELECT event_id, event_type AS event, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "event_scores": """
        SELECT event_type, floor(avg(least(1, greatest(0, coalesce((props::JSON ->> 'k')::DOUBLE / 100, 0.5)))) * 1e6 + 0.5) / 1e6 AS score, count(*) AS n FROM events GROUP BY event_type""",
    "report_sequence": f"""
        WITH {SCORED}, {PANEL},
        ended AS (SELECT h.session_id, count(reply) = 0 AS failed FROM has h CROSS JOIN panel p LEFT JOIN reply r ON h.session_id = r.session_id AND p.panel_no = r.panel_no GROUP BY ALL),
        told AS (
            SELECT session_id, ['stage_started'] || (CASE WHEN len(flags) > 0 THEN ['risk_detected'] ELSE [] END) || ['stage_started'] || list_transform(range(6), lambda i: 'agent_result')
                   || (CASE WHEN failed THEN ['error'] ELSE ['stage_started', 'report', 'completed'] END) AS e FROM flags JOIN ended USING (session_id)
        )
        SELECT session_id, (generate_subscripts(e, 1) - 1)::INT AS seq, unnest(e) AS event FROM told""",
    "masked_keys": "SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN substr(c_name, 1, 3) || '…' || right(c_name, 4) WHEN c_name = '' THEN '' ELSE '…' END AS masked FROM customer",
    "panel_reports": f"""
        WITH {SCORED}, {TOP},
        o(name, school, treatment, formula) AS (VALUES {", ".join(str(r) for r in OVERRIDES)}),
        base(name, treatment, formula) AS (VALUES {", ".join(f"('{r[0]}', '{r[2]}', {repr(r[3]) if r[3] else 'NULL'})" for r in (rules.YANG, rules.QI, rules.HEAT, rules.NOTHING))})
        SELECT session_id, school, name AS diagnosis, score AS confidence, coalesce(o.treatment, base.treatment) AS treatment,
               CASE WHEN coalesce(len(flags), 0) = 0 THEN coalesce(o.formula, base.formula, '{rules.NO_FORMULA}') ELSE '' END AS formula, coalesce(array_to_string(flags, ','), '') AS flags
        FROM top CROSS JOIN (SELECT unnest({list(SCHOOLS)}) AS school) JOIN flags USING (session_id) JOIN base USING (name) LEFT JOIN o USING (name, school)""",
    "panel_merge": f"""
        WITH {SCORED}, {PANEL}, {TOP},
        op AS (
            SELECT t.session_id, school, p.panel_no AS no, CASE WHEN length(reply) > {SECOND_VIEW} THEN 'second view' ELSE name END AS diagnosis,
                   score + 0.01::DOUBLE * least(coalesce(len(string_split(reply, chr(10))), 0), 6)::DOUBLE AS confidence
            FROM top t CROSS JOIN panel p LEFT JOIN reply r ON t.session_id = r.session_id AND p.panel_no = r.panel_no
        ),
        lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, no) AS n FROM op) WHERE n = 1)
        SELECT l.session_id, l.diagnosis AS lead, l.school AS lead_school, l.confidence AS confidence, count(DISTINCT o.diagnosis) AS diagnoses,
               coalesce(string_agg(o.school, ',' ORDER BY o.school) FILTER (o.diagnosis = l.diagnosis), '') AS consensus, coalesce(string_agg(o.school, ',' ORDER BY o.school) FILTER (o.diagnosis <> l.diagnosis), '') AS divergence
        FROM op o JOIN lead l ON o.session_id = l.session_id GROUP BY l.session_id, l.diagnosis, l.school, l.confidence""",
}
