import math

import pytest

from lexmill.llm import language
from lexmill.llm.language import WORD, LanguageModel, fit_languages, identify, predict_languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_do_not_leak(docs):
    """Held-out labels and sources can be anything without changing a prediction."""
    from pyspark.sql import functions as F

    from lexmill.llm.common import crc_mod

    changed = docs.withColumn("lang", F.when(crc_mod(F.col("doc_id"), 4) == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    key = lambda f: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in identify(f).collect())
    assert key(docs) == key(changed)


def test_odd_documents(odd, nothing):
    rows = {r["doc_id"]: r for r in identify(odd).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[5]["lang_pred"] == "en"
    assert identify(nothing).count() == 0
    assert fit_languages(nothing.select("doc_id", "text", "lang")).languages == []


def test_backoff_prefers_words_then_long_grams():
    model = LanguageModel.of(["a", "b"], {"word": (-1.0, -2.0)}, {"<wo": (-1.0, -5.0), "w": (-9.0, -1.0), "o": (-3.0, -1.0)})
    assert tuple(model.word("word")) == (-1.0, -2.0)
    assert tuple(model.word("wox")) == (-1.0, -5.0)
    assert tuple(model.word("ow")) == (-6.0, -1.0)
    assert tuple(model.word("zzz")) == (0.0, 0.0)


def test_predictions_equal_a_slow_sum(spark, docs, monkeypatch):
    """Language and score of every document by adding up its words one by one, also with a table too small for a text."""
    model = fit_languages(docs.filter("lang is not null and doc_id % 2 = 0").select("doc_id", "text", "lang"))
    want = {}
    for r in docs.collect():
        total = [0.0] * len(model.languages)
        for w in WORD.findall((r["text"] or "").lower()):
            total = [a + float(b) for a, b in zip(total, model.word(w), strict=True)]
        best = max(range(len(total)), key=lambda k: total[k])
        want[r["doc_id"]] = model.languages[best], 1 / sum(math.exp(x - total[best]) for x in total)
    scores = language.WordScores(model)
    for r in predict_languages(docs, model).collect():
        if r["lang_pred"] != "und":
            assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1])
    monkeypatch.setattr(language, "CACHE", 7)
    small = language.WordScores(model)
    words = WORD.findall(docs.first()["text"].lower())
    assert small.total(words) == pytest.approx(scores.total(words))


def test_ties_go_to_the_first_language(spark):
    model = LanguageModel.of(["a", "b"], {"x": (-1.0, -1.0)}, {})
    row = predict_languages(spark.createDataFrame([(1, "x x")], "doc_id long, text string"), model).first()
    assert (row["lang_pred"], row["score"]) == ("a", 0.5)
