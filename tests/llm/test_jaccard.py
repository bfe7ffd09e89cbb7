import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import jaccard_join as j
from lexmill.session import scratch, shared_dir, stage


def slow_classes(rows):
    """Components by comparing every two documents."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc_id, text in rows:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(lower)) if w]
        sets.append((doc_id, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(k)]) for k, (doc_id, s) in enumerate(sets))


def variants(seed, groups=12, most=14):
    """Groups of texts with words changed at many rates, so that similarities lie on both sides of the border."""
    rng = random.Random(seed)
    rows, passage = [], [f"shared{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{g}_{i}" for i in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, most)):
            words = [w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.05]) else f"x{rng.random()}" for w in base]
            rows.append(words + (passage if rng.random() < 0.3 else []))
    return [(i, rng.choice([" ", "\n"]).join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = variants(seed)
    got = sorted(map(tuple, j.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == slow_classes(rows)


def test_regions_in_blocks(spark, monkeypatch):
    """Regions cut into blocks give the same classes."""
    monkeypatch.setattr(j, "BLOCK", 256)
    rows = variants(7, groups=4, most=40)
    assert sorted(map(tuple, j.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == slow_classes(rows)


@pytest.mark.parametrize(("cell", "pivots"), [(2000, (2, 4)), (700, (3, 8)), (700, (1, 1))])
def test_cells_and_windows(spark, monkeypatch, cell, pivots):
    """Regions cut into Voronoi cells, and these again, give the same classes, whatever the pivots and blocks."""
    monkeypatch.setattr(j, "CELL", cell)
    monkeypatch.setattr(j, "BLOCK", 4 * cell)
    monkeypatch.setattr(j, "PIVOTS", pivots)
    rows = variants(11, groups=3, most=60)
    assert sorted(map(tuple, j.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == slow_classes(rows)


def test_windows_lose_no_pair():
    """Any two members within the radius come to one cell, where one of them is at home; groups of pivots are connected."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 60)
        sets = [np.unique(np.concatenate([base[rng.random(60) > rng.choice([0.05, 0.2, 0.4])], rng.integers(0, 1 << 40, rng.integers(1, 20))])) for _ in range(40)]
        table = pa.table({
            "pivot_hi": pa.array([1] * 40), "pivot_lo": pa.array([2] * 40), "path": pa.array([""] * 40), "m": pa.array(range(40)), "h": pa.array(range(40)),
            "n": pa.array([len(x) for x in sets]), "items": pa.array([x.tobytes() for x in sets], pa.binary()), "members": pa.array([40] * 40), "weight": pa.array([9] * 40),
        })
        out = j.measure(table, table.slice(0, 5)).to_pylist()
        met = {}
        for r in out:
            for c in [r["cell"], *r["into"]]:
                met.setdefault(c, []).append((r["m"], c == r["cell"]))
        pairs = {(a, b) for members in met.values() for a, home_a in members for b, home_b in members if home_a or home_b}
        near = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        assert all((a, b) in pairs for a in range(40) for b in range(a) if near(a, b))
        assert sorted(r["m"] for r in out) == list(range(40))
        linked = slow_links(sets[:5])
        for r in out:
            if r["pm"] is not None:
                assert near(r["m"], r["cell"]) and linked[r["pm"]] == linked[r["cell"]]


def slow_links(sets):
    """Component of each set by comparing every two."""
    out = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
                    out[a] = out[b] = min(out[a], out[b])
    return out


def test_dense_regions_are_only_measured(spark, monkeypatch):
    """A large region of near copies is linked through its pivots; no member comes into another's cell."""
    monkeypatch.setattr(j, "CELL", 2000)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if rng.random() > 0.001 else "x" for w in base) + f" e{i}") for i in range(80)]
    plan = []
    real = j.cells
    monkeypatch.setattr(j, "cells", lambda regions, depth: plan.append(real(regions, depth)) or plan[-1])
    got = sorted(map(tuple, j.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == slow_classes(rows) and plan
    assert all(r["home"] for r in plan[0].select("home").distinct().collect())


def loose(n):
    """Texts that share some of their prefix shingles, most of them with no other text within the radius."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join([*shared[: rng.randint(12, 30)], *(f"u{i}_{k}" for k in range(rng.randint(30, 60)))])) for i in range(n)]
    return [*rows, (n, rows[0][1] + " more"), (n + 1, rows[1][1] + " more")]


def no_common(monkeypatch):
    monkeypatch.setattr(j, "common_shingles", lambda docs: (np.empty(0, np.int64),) * 2)


def test_large_loose_regions_are_sketched(spark, monkeypatch):
    """Sets of a region over the bound are fetched only where the sketches leave hope; the region isn't copied from cell to cell."""
    no_common(monkeypatch)
    monkeypatch.setattr(j, "CELL", 1500)
    monkeypatch.setattr(j, "BLOCK", 1500)
    wanted, plan = [], []
    real, cut = j.shingle_sets, j.cells
    monkeypatch.setattr(j, "shingle_sets", lambda docs, ids: wanted.append(ids.count()) or real(docs, ids))
    monkeypatch.setattr(j, "cells", lambda regions, depth: plan.append(depth) or cut(regions, depth))
    rows = loose(80)
    got = sorted(map(tuple, j.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == slow_classes(rows)
    assert wanted[0] <= 10 and not plan


def test_passes_over_shingles(spark, monkeypatch):
    """A large table's prefixes are shuffled in passes; seeds and classes are the same."""
    staged, real = [], j.stage
    monkeypatch.setattr(j, "stage", lambda frame, name, *a, **k: staged.append(name) or real(frame, name, *a, **k))
    rows = variants(17, groups=5)
    heads = j.sketch(spark.createDataFrame(rows, "doc_id long, text string")).filter("prefix is not null")
    want = sorted(map(tuple, j.seed_regions(heads, len(rows)).collect()))
    monkeypatch.setattr(j, "PASS", max(1, len(rows) // 2))
    assert sorted(map(tuple, j.seed_regions(heads, len(rows)).collect())) == want and want
    assert staged.count("seeds") == 1 + 1 + len(rows) // j.PASS


@pytest.mark.parametrize("block", [300, 1200])
def test_bands_and_blocks_of_sketches(spark, monkeypatch, block):
    monkeypatch.setattr(j, "CELL", 300)
    monkeypatch.setattr(j, "BLOCK", block)
    rows = variants(13, groups=4, most=30)
    assert sorted(map(tuple, j.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == slow_classes(rows)


def test_bands_hold_the_radius():
    """Two sizes within the radius are in one band or in two next to each other."""
    band = lambda n: int(np.floor(np.log(n) / np.log(j.BAND)))
    assert all(band(n) - band(-(-3 * n // 4)) <= 1 for n in range(1, 200_000))


def test_windows_never_copy_more_than_blocks(spark, monkeypatch):
    """A region whose members are far from all pivots stays one cell, since its windows would hold every member in every cell."""
    monkeypatch.setattr(j, "CELL", 2000)
    monkeypatch.setattr(j, "BLOCK", 2000)
    rng = np.random.default_rng(5)
    monkeypatch.setattr(j, "PIVOTS", (30, 64))
    sets = [np.unique(rng.integers(0, 400, 100)) for _ in range(60)]
    weight = sum(len(x) + j.MEMBER for x in sets)
    rows = [(1, 2, "", k, k, len(x), x.tobytes(), len(sets), weight) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "pivot_hi long, pivot_lo long, path string, m long, h long, n long, items binary, members long, weight long")
    out = j.cells(frame, 0).collect()
    assert sorted(r["m"] for r in out) == list(range(60)) and len({r["path"] for r in out}) == 1 and all(r["home"] for r in out)


def test_chance_partners_of_other_sizes_share_no_region(spark, monkeypatch):
    no_common(monkeypatch)
    rows = [(i, " ".join(["a b c d e", *(f"u{i}_{k}" for k in range(8 * 2**i))])) for i in range(7)]
    heads = j.sketch(spark.createDataFrame(rows, "doc_id long, text string"))
    assert j.seed_regions(heads, 7).count() == 0


def test_staged_tables_go_when_used_up(spark):
    """The result rests on two narrow tables; the shuffle files of what was staged are gone too."""
    with scratch(spark):
        place = Path(shared_dir(spark).removeprefix("file:"), "lexmill")
        before = set(place.iterdir()) if place.exists() else set()
        found = j.near_classes(spark.createDataFrame(variants(3, groups=4), "doc_id long, text string"))
        assert sorted(p.name.split("-")[0] for p in set(place.iterdir()) - before) == ["labelled", "rows"]
        assert found.count() > 0
    assert set(place.iterdir()) <= before


def test_staging_leaves_no_shuffle_files(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = set()
        while files.hasNext():
            name = files.next().getName()
            if name.startswith("shuffle_"):
                out.add(name)
        return out

    before, after = held(), set()
    with scratch(spark):
        stage(spark.range(1000).repartition(4, "id").groupBy("id").count(), "counted")
        for _ in range(50):
            after = held() - before
            if not after:
                break
            time.sleep(0.2)
    assert not after


def test_one_id_with_two_texts(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b = words("a", 60), words("b", 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in j.near_classes(frame).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted((r["doc_id"], r["text"] or "") for r in j.drop_near_copies(frame).collect()) == [(1, rows[0][1]), (1, rows[1][1]), (4, ""), (4, "")]


def test_region_components():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 1 << 40, 80)
        sets = []
        for _ in range(25):
            kept = base[rng.random(80) > rng.choice([0.0, 0.05, 0.12])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 40, rng.integers(1, 12))])))
        component = j.join_region(sets)
        links = [(a, b) for a in range(25) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
        parent = list(range(25))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        assert [[component[a] == component[b] for b in range(25)] for a in range(25)] == [[find(a) == find(b) for b in range(25)] for a in range(25)]


def test_odd_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300))) for _ in range(2))
        b = np.union1d(b, rng.choice(a, len(a) // 2))
        x, y = (np.frombuffer(j.parity_bits(s), np.uint8) for s in (a, b))
        width = min(len(x), len(y))
        differ = int(np.bitwise_count(j.folded(x, width) ^ j.folded(y, width)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_odd_documents(odd, nothing):
    rows = {r["doc_id"]: r for r in j.near_classes(odd).collect()}
    assert len(rows) == 12 and rows[1]["n_shingles"] == 0 and rows[2]["component_id"] == 2 and rows[4]["n_shingles"] == 1
    assert rows[5]["component_id"] == rows[6]["component_id"] == rows[7]["component_id"] == 5
    assert j.near_classes(nothing).count() == 0
    kept = j.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]
    assert j.drop_near_copies(nothing).count() == 0


def test_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "a long, b long")
    assert {r["label"] for r in j.classes(edges).collect()} == {1}
