import corpus_pipeline
from lexmill.llm.toxicity import fit_toxicity, training_labels, words_of
from lexmill.session import stage
from tests.llm.test_dedup import LOWER
from tests.llm.test_jaccard import slow_classes
from tests.llm.test_packing import check
from tests.llm.test_quality import slow_verdicts


def test_stages_keep_columns_and_order(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "exact_dedup", "ngram_jaccard_join", "packing"]
    frame, before = docs, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        frame = stage(function(spark, frame, "/root/testdata/sf0.001"), name)
        assert frame.columns == docs.columns and frame.count() <= before
        before = frame.count()
    ids = {r["doc_id"] for r in frame.collect()}
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in packed} == ids


def test_odd_documents_pass_all_stages(spark, odd, nothing):
    for frame in (odd, nothing):
        for name, function in corpus_pipeline.STAGES[:-1]:
            frame = stage(function(spark, frame, "/root/testdata/sf0.001"), name)
        corpus_pipeline.STAGES[-1][1](spark, frame, "").collect()


def test_every_stage_equals_brute_force(spark, docs, labels):
    """Each stage, over all that its predecessor kept, keeps what slow loops keep; the last packs whole texts once."""
    stages, folder = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    step = lambda name, frame: stage(stages[name](spark, frame, folder), name)
    ids = lambda frame: sorted(r["doc_id"] for r in frame.collect())

    rows = docs.collect()
    good = step("quality_rules", docs)
    kept, _, _ = slow_verdicts([r["text"] for r in rows])
    assert ids(good) == sorted(r["doc_id"] for r, k in zip(rows, kept, strict=True) if k)

    rows, clean = good.collect(), step("toxicity", good)
    model = fit_toxicity(good, training_labels(labels))
    assert ids(clean) == sorted(r["doc_id"] for r in rows if model.score(model.passages(words_of(r["text"]))) < 0.7)

    rows, once = clean.collect(), step("exact_dedup", clean)
    last = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        last[(r["text"] or "").translate(LOWER)] = r["doc_id"]
    assert ids(once) == sorted(last.values())

    rows, near = once.collect(), step("ngram_jaccard_join", once)
    found = slow_classes([(r["doc_id"], r["text"]) for r in rows])
    assert ids(near) == sorted({c for _, _, c in found})

    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    pieces = step("packing", near).collect()
    check(pieces, texts)
    assert {r["doc_id"] for r in pieces} == set(texts)
