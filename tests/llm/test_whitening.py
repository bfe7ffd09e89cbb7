import math

import numpy as np
import pytest

from lexmill.llm.queries import op12_whitening
from lexmill.llm.whitening import range_finder, whiten
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, x string, size int, component string"


def check(rows, given, components=4):
    """Rows of whiten() against numpy over the distinct vectors of one length."""
    kept = [(i, [math.floor(256.0 * c) for c in v]) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, size = fit.shape
    sums = fit.sum(axis=0)
    centred = (fit - np.array([s / n for s in sums])).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = min(components, int((values > 1e-12 * values[0]).sum()))
    got = {}
    for r in rows:
        got.setdefault(r["component"], []).append(r)
    assert sorted(got) == list(range(1, top + 1))
    exact = {(i, tuple(x)): sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    for k in range(top):
        here = got[k + 1]
        assert len(here) == len(kept) and {r["n"] for r in here} == {n}
        assert sorted((str(r["vec_id"]), r["deviation"]) for r in here) == sorted((str(i), exact[i, tuple(x)]) for i, x in kept)
        assert all(abs(r["explained"] / (values[k] / np.trace(cov)) - 1) < 1e-9 for r in here)
        want = sorted((str(i), exact[i, tuple(x)], float((np.array(x, float) - centred_mean(sums, n)) @ vectors[:, k] / math.sqrt(values[k]))) for i, x in kept)
        have = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in here)
        a, b = np.array([w for *_, w in want]), np.array([w for *_, w in have])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7 * max(1.0, np.abs(a).max())
    assert all(r["identity_error"] <= 1e-9 for r in rows) and len({r["identity_error"] for r in rows}) == 1


def centred_mean(sums, n):
    return np.array([s / n for s in sums])


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_query_against_numpy(spark, folder):
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op12_whitening(spark, folder).collect(), given)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    given = [(k, list(map(float, rng.normal(size=6) * [9, 5, 3, 2, 1, 1]))) for k in range(40)]
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (52, [math.nan] * 6), (53, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (54, [-math.inf] * 6)]
    more = [*given, *bad, *[(7, given[7][1])] * 500, (None, given[3][1]), (8, given[9][1])]
    rows = whiten(spark.createDataFrame([(i, v, "x", 1, "c") for i, v in more], SCHEMA).repartition(5)).collect()
    check(rows, more)


def test_lengths_apart_and_without_spread(spark):
    given = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, 7.0]), (4, [1.0]), (5, []), (6, [3.0, 3.0, 3.0]), (6, [3.0, 3.0, 3.0])]
    rows = whiten(spark.createDataFrame([(i, v, "x", 1, "c") for i, v in given], SCHEMA)).collect()
    check([r for r in rows if r["vec_id"] in (1, 2, 3)], given[:3])
    assert {r["vec_id"] for r in rows} == {1, 2, 3}
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_entries(spark):
    given = [(1, [1e15, 0.0]), (2, [-1e15, 3.0]), (3, [5.0, 1e-9]), (4, [1e300, 1.0])]
    rows = whiten(spark.createDataFrame([(i, v, "x", 1, "c") for i, v in given[:3]], SCHEMA)).collect()
    assert {r["deviation"] for r in rows if r["vec_id"] != 3} == {None}
    assert whiten(spark.createDataFrame([(i, v, "x", 1, "c") for i, v in given], SCHEMA)).select("vec_id").distinct().count() == 4


def test_range_finder_stops_early_or_goes_to_full_dimension():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(80, 80)))[0]
    for values, full in ((np.concatenate([[4000.0, 3000, 2000, 1000], np.full(76, 1e-9)]), False), (np.linspace(2, 1, 80), True)):
        passes = []
        cov = turn @ np.diag(values) @ turn.T

        def times(q, cov=cov, passes=passes):
            passes.append(q.shape[1])
            return cov @ q

        found, vectors, went = range_finder(times, 80, 4)
        assert went == full and (80 in passes) == full
        assert np.allclose(found[:4], np.sort(values)[::-1][:4], rtol=1e-12)
        assert np.abs(cov @ vectors[:, :4] - vectors[:, :4] * found[:4]).max() < 1e-11 * values.max()
