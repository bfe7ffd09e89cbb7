"""What a worker holds at once doesn't grow with the rows that come in one batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions.vectors import hash_vectors
from lexmill.operators import postings, retrieval


def batch(docs=6000, words=400):
    """One Arrow batch of (key, bag)."""
    word = np.random.default_rng(3).integers(0, 5000, docs * words)
    names = pa.array([f"w{i}" for i in range(5000)])
    return pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * words, pa.int32()), names.take(pa.array(word)))], names=["key", "bag"])


def body(spark, operator):
    """The function that an operator gives to mapInArrow()."""
    caught = []
    docs = SimpleNamespace(sparkSession=spark, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: caught.append(run)))
    operator(docs)
    return caught[0]


@pytest.mark.parametrize("name", ["blocks", "counts", "vectors"])
def test_arrays_of_a_batch_are_bounded(spark, monkeypatch, name):
    monkeypatch.setattr(postings, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = {
        "blocks": lambda: lambda b: postings.build_blocks(b, 0, postings.SLICE),
        "counts": lambda: body(spark, lambda d: retrieval.term_counts(d, F.lit(None), [f"w{i}" for i in range(0, 5000, 5)])),
        "vectors": lambda: body(spark, lambda d: hash_vectors(d, F.lit(None), "key", 64)),
    }[name]()
    given = batch()
    tracemalloc.start()
    rows = sum(x.num_rows for x in run(iter([given])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= given.num_rows if name != "blocks" else rows > 0
    assert peak < (30e6 if name == "counts" else 70e6)


def test_files_are_unpacked_few_at_a_time():
    from lexmill.sources.binary import by_bytes

    given = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (3, 0, 4, 50, 1, 1)] + [None])], names=["content"])
    assert [b.column(0).to_pylist() for b in by_bytes(iter([given]), "content", 8)] == [[b"xxx", b"", b"xxxx"], [b"x" * 50], [b"x", b"x", None]]
