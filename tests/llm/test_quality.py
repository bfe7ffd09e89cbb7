import re
from collections import Counter

import numpy as np

from lexmill.llm.quality import RULES, keep_good, quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = [False] * len(words)
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            covered[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(covered)


def check(frame):
    texts = [(r["doc_id"], r["text"]) for r in frame.collect()]
    rows = quality(frame).collect()
    key = lambda x: (x[0] is None, x)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=key)
    assert got == sorted(((i, *counts(t)) for i, t in texts), key=key)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    return rows


def test_counts(docs):
    check(docs)


def test_odd_documents(odd, nothing):
    rows = {r["doc_id"]: r for r in check(odd)}
    assert not rows[1]["kept"] and not rows[9]["kept"] and rows[5]["kept"]
    assert quality(nothing).count() == 0 and keep_good(nothing).count() == 0


def test_keeping_agrees_with_scoring(odd):
    kept = keep_good(odd)
    assert kept.schema == odd.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in quality(odd).collect() if r["kept"])


def test_agrees_with_labels(spark):
    """Votes know nothing of the labels, yet part good from bad."""
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality as good")
    rows = quality(spark.read.parquet(f"{folder}/documents.parquet")).join(truth, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == bool(r["good"]) for r in rows) >= 0.97 * len(rows)


def slow_verdicts(texts):
    """Verdicts with one weight a document instead of counted vote patterns, from counts by regular expressions."""
    votes, failed = [], []
    for text in texts:
        words, chars, symbols, copies, repeats = counts(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        value = {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": copies, "n_repeat_words": repeats, "n_lines": lines,
                 "n_capitals": len(re.findall("[A-Z]", text or "")), "n_shouts": (text or "").count("!")}
        row = []
        for _, what, good_from, good_to, bad_below, bad_above in RULES:
            top, _, bottom = what.partition(" / ")
            x = value[top] if not bottom else value[top] / value[bottom] if value[bottom] else None
            row.append(0 if x is None else -1 if x < bad_below or x > bad_above else int(good_from <= x <= good_to))
        votes.append(row)
        failed.append(words < 10 or 100 * repeats > 20 * words)
    v = np.array(votes)
    good = 1 / (1 + np.exp(-(0.5 * (v > 0) - 2 * (v < 0)).sum(axis=1)))
    for _ in range(300):
        up = [((v > 0) * w[:, None]).sum(axis=0) + 1 for w in (good, 1 - good)]
        down = [((v < 0) * w[:, None]).sum(axis=0) + 1 for w in (good, 1 - good)]
        p, q = (u / (u + d) for u, d in zip(up, down, strict=True))
        pooled = (up[0] + up[1]) / (up[0] + up[1] + down[0] + down[1])
        p, q = np.where(p < q, pooled, p), np.where(p < q, pooled, q)
        prior = (good.sum() + 1) / (len(v) + 2)
        odds = np.log(prior / (1 - prior)) + ((v > 0) * np.log(p / q)).sum(axis=1) + ((v < 0) * np.log((1 - p) / (1 - q))).sum(axis=1)
        good = 1 / (1 + np.exp(-odds))
    return [bool(g >= 0.5) and not f for g, f in zip(good, failed, strict=True)], [bool((row < 0).any()) for row in v], failed


def test_verdicts_equal_slow_estimation(docs):
    rows = docs.collect()
    want, _, _ = slow_verdicts([r["text"] for r in rows])
    got = {r["doc_id"]: r["kept"] for r in quality(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == want


def test_differs_from_all_must_pass(spark):
    """One bad vote among good ones doesn't drop a document; several do."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    kept, any_bad, failed = slow_verdicts([r["text"] for r in rows])
    saved = [b and k for k, b in zip(kept, any_bad, strict=True)]
    dropped = [b and not k and not f for k, b, f in zip(kept, any_bad, failed, strict=True)]
    assert any(saved) and any(dropped)
    assert not any(not k and not b and not f for k, b, f in zip(kept, any_bad, failed, strict=True))


def test_clashing_names(odd):
    named = odd.withColumnRenamed("key", "__RULES").withColumnRenamed("prefix", "votes")
    assert keep_good(named).columns == named.columns and keep_good(named).count() == keep_good(odd).count()
