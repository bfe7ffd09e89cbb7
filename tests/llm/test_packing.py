import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm.packing import WordIds, best_pattern, generate_columns, pack, plan_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    """Every id lies in one piece, sequences are gapless and no longer than the capacity."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, pieces in by_doc.items():
        ids = np.array(library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert all(p["doc_tokens"] == len(ids) for p in pieces)
        covered = np.zeros(len(ids), int)
        for p in pieces:
            covered[p["start"] : p["start"] + p["length"]] += 1
            assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        assert len(set(covered.tolist())) == 1  # once for each row of the document
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    return len(by_sequence)


def test_packs_all_documents(docs):
    rows = pack(docs, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    sequences = check(rows, texts)
    assert sequences <= 1.05 * sum(r["length"] for r in rows) / 4096 + 1


def test_odd_documents(odd, nothing):
    rows = pack(odd, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check(rows, texts)
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert sum(r["doc_id"] == 5 for r in rows) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] == 9) > 2 * 4096
    assert pack(nothing, PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_encoder_equals_library(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdeth  \n\t'strellÉéñßΣİJ̌中文字🙂١²Ⅷ\x1c\x85\xa0.,!##12K") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(400)]
    library = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, WordIds(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_knapsack_takes_the_best_pattern():
    worth, pattern = best_pattern(np.array([0.1, 0.25, 0.55, 0.0, 0.0, 0.0, 0.0]), 7)
    assert worth == pytest.approx(0.1 + 0.55 * 2) and pattern.tolist()[:3] == [1, 0, 2]


def test_linear_program_reaches_the_bound():
    demand = np.zeros(100, np.int64)
    demand[[44, 54]], demand[29] = (300, 300), 300
    patterns, amount = generate_columns(demand)
    assert (amount @ patterns >= demand - 1e-6).all() and amount.sum() == pytest.approx(400, rel=1e-3)


def test_plan_gives_every_piece_a_place():
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 50, 256)
    plan, room = plan_sequences(demand), {}
    for size in range(1, 257):
        n = int(demand[size - 1])
        for s in plan.sequence(np.full(n, size), np.arange(n)):
            room[int(s)] = room.get(int(s), 0) + size
    assert max(room.values()) <= 256 and len(room) <= demand @ np.arange(1, 257) / 256 * 1.02 + 2
