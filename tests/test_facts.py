"""Facts found in the words of a session."""

from lexmill.operators.rules import found_facts

CUES = [("cold", "shiver", "yes"), ("cold", "warm", "no"), ("heat", "warm", "yes"), ("age", "seven", "7"), ("age", "seven", "07")]


def facts(spark, turns):
    cues = spark.createDataFrame(CUES, "key string, cue string, value string")
    frame = spark.createDataFrame(turns, "id long, n long, said string")
    return {r[0]: r[1] for r in found_facts(frame, cues, "id", "n", "said").collect()}


def test_latest_statement_counts(spark):
    turns = [
        (1, 2, "Warm now."), (1, 1, "I SHIVER, shiver"), (2, 1, "warm, then shiver"), (3, 1, "nothing of it: warmth"), (4, 1, None), (5, 1, ""),
        (6, None, "shiver"), (6, 1, "seven"), (None, 1, "warm"),
    ]
    assert facts(spark, turns) == {
        1: {"cold": "no", "heat": "yes"}, 2: {"cold": "yes", "heat": "yes"}, 3: {}, 4: {}, 5: {}, 6: {"cold": "yes", "age": "7"}, None: {"cold": "no", "heat": "yes"},
    }


def test_no_turns(spark):
    assert facts(spark, []) == {}


def test_long_session_and_repeated_rows(spark):
    turns = [(1, n, "shiver " * 50) for n in range(2000)] + [(1, 2000, "warm"), (1, 2000, "warm")]
    assert facts(spark, turns) == {1: {"cold": "no", "heat": "yes"}}
