import math
import random
import time

import pytest

from lexmill.llm.toxicity import GAP, drop_toxic, fit_toxicity, segments, toxic_passages, toxicity, words_of


def slow_segments(scores):
    """All maximal segments by definition: the best contiguous run, then the same to its left and right."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    right = [(a + j + 1, b + j + 1, s) for a, b, s in slow_segments(scores[j + 1 :])]
    return slow_segments(scores[:i]) + [(i, j, best)] + right


def test_segments_equal_definition():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-GAP] * 5 + [0.61, 1.07, 2.13, 0.83]) * 1.0 for _ in range(rng.randint(0, 25))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = [(a, b, pytest.approx(s)) for a, b, s in segments(hits, GAP)]
        assert got == slow_segments(scores)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hits = [r for r in rows if r["predicted"]]
    assert sum(r["toxic"] for r in hits) >= 0.97 * len(hits)
    assert len(hits) >= 0.7 * sum(r["toxic"] for r in rows)


def test_odd_documents(odd, nothing, few_labels):
    rows = toxicity(odd, few_labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert drop_toxic(odd, few_labels).schema == odd.schema
    assert drop_toxic(odd, few_labels).count() == sum(not r["predicted"] for r in rows)
    assert toxicity(nothing, few_labels).count() == 0
    assert toxicity(odd, few_labels.limit(0)).filter("predicted = 1").count() == 0


def test_only_near_copies_count_once(spark):
    """Toxic texts that share a passage, or are made from clean ones, all count; copies of one text don't, in any order."""
    rng = random.Random(4)
    own = lambda k: [f"w{k}x{rng.randrange(10**6)}" for _ in range(60)]
    shared = [f"shared{i}" for i in range(60)]
    clean = {k: shared + own(k) for k in range(100)}
    toxic = {100 + k: [*clean[k][:117], "grubbish", *clean[k][117:]] for k in range(40)}
    copied = own(1000)
    copies = {200 + k: ["zork", *copied[:50], f"end{k}"] for k in range(40)}
    texts = [(k, " ".join(w)) for k, w in (clean | toxic | copies).items()]
    labels = spark.createDataFrame([(k, int(k >= 100)) for k, _ in texts], "doc_id long, toxic int")
    models = []
    for _ in range(2):
        rng.shuffle(texts)
        models.append(fit_toxicity(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), labels))
    assert models[0] == models[1]
    assert "grubbish" in models[0].lexicon and "zork" not in models[0].lexicon


def test_segments_are_linear():
    """Hits far apart stay segments of their own; the scan doesn't look back over all of them."""
    began = time.process_time()
    hits = [(40 * i, 1.0) for i in range(200_000)]
    assert len(segments(hits, GAP)) == len(hits)
    assert time.process_time() - began < 5


def test_column_in_another_case(odd, few_labels):
    named = odd.withColumnRenamed("text", "TEXT").withColumnRenamed("lang", "__id")
    assert drop_toxic(named, few_labels).count() == drop_toxic(odd, few_labels).count()


def test_scores_equal_a_slow_scan(spark, docs, labels):
    """Every score follows from the model and the passages found by definition."""
    model = fit_toxicity(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxic_passages(docs.filter("length(text) < 1000"), model).collect():
        words = words_of(texts[r["doc_id"]])
        slow = slow_segments([model.lexicon.get(w, -GAP) for w in words])
        bits = [model.decay * s - math.log(len(words)) for _, _, s in slow]
        strong = [b for b in bits if 1 - math.exp(-math.exp(-b)) < 0.05]
        strength = math.log1p(max(strong)) + math.log1p(len(strong)) if strong else None
        want = model.base if strength is None else 1 / (1 + math.exp(-(model.bias + model.slope * strength)))
        assert r["score"] == pytest.approx(want)
