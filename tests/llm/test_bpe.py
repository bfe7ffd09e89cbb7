import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm import bpe
from lexmill.llm.bpe import codec, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_equals_library(request, library, name):
    frame = request.getfixturevalue(name)
    got = sorted(tuple(r[1:]) for r in encode_documents(frame, PATH).collect())
    assert got == sorted(expected(library, r["text"]) for r in frame.collect())


def test_empty_table(nothing):
    assert encode_documents(nothing, PATH).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a \n b", "<|endoftext|>", "x<|endoftext|> y", "a" * 3000, "the" * 2000, " " * 700, "\n\n \t", "don't we'll", "🙂é中 ١²"])
def test_hard_texts(library, text):
    assert ",".join(x for x in codec(PATH).encode(text) if x) == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_random_texts(library):
    rng = np.random.default_rng(4)
    letters = list("abcdeth  \n\t'streéñß中🙂١²\x85\xa0.,!#12")
    for _ in range(600):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert ",".join(x for x in codec(PATH).encode(text) if x) == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def words(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["th", "ing", "ed", "er", "on", "é", "ß", "tion", "wh", "中", "an", "x", "'s", ".", ",", "12", "\n", "ible", "sh"]
    return ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(n)]


def test_ordinary_pieces_are_encoded_together(library, monkeypatch):
    """One piece at a time costs too many CPU seconds; only long pieces and a few leftovers may go that way."""
    calls = []
    plain = bpe.Codec.encode_piece
    monkeypatch.setattr(bpe.Codec, "encode_piece", lambda self, piece: calls.append(piece) or plain(self, piece))
    engine = bpe.Codec(PATH)
    text = " ".join(words(5000, 1)) + " " + "the" * 100
    assert ",".join(engine.encode(text)) == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
    assert len(calls) < 100


@pytest.mark.parametrize("few", [0, 10**9])
def test_small_bounds(library, monkeypatch, few):
    """Full caches, pairs that share places, pieces taken back alone or in step, odd texts among others: the same ids."""
    for name, value in {"CACHE": 50, "PAIRS": 16, "LONG": 12, "FEW": few}.items():
        monkeypatch.setattr(bpe, name, value)
    engine = bpe.Codec(PATH)
    some = words(3000, 2)
    odd = ["", " ", " a", "b ", "c  d", "e \n f", "\ng h", "i j\n", "<|endoftext|>", "k<|endoftext|><|endoftext|> l", "\x1c m", "a" * 200, "\x85", "é " * 40]
    texts = [t for k in range(0, 3000, 60) for t in [" ".join(some[k : k + 60]), odd[k // 60 % len(odd)]]]
    for at in range(0, len(texts), 20):
        block = texts[at : at + 20]
        assert engine.encode_texts(block) == [",".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in block]


def test_pairs_at_once():
    engine = bpe.Codec(PATH)
    rng = np.random.default_rng(3)
    left, right = (rng.integers(0, 50256, 20_000) for _ in range(2))
    halves = np.array(list(engine.rank))[rng.integers(0, len(engine.rank), 5000)]
    left, right = np.append(left, halves[:, 0]), np.append(right, halves[:, 1])
    for _ in range(2):
        assert engine.fit_pairs(left, right).tolist() == [engine._fits(int(a), int(b)) for a, b in zip(left, right)]
