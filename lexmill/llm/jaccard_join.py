"""Operator 8: exact Jaccard self-join of documents in metric space, and its connected classes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import free_name, in_slices, join_groups
from lexmill.session import scratch, stage

SHINGLE = 5
#: Similarity of at least NUMERATOR / DENOMINATOR; as a distance, RADIUS at most.
NUMERATOR, DENOMINATOR = 75, 100
RADIUS = 1 - NUMERATOR / DENOMINATOR
#: Documents whose shingles are counted to find very common ones: so many or one in COUNTED_SHARE, so that what isn't found is
#: as rare in a large table as in a small one. The count only orders shingles and can't change a result.
COUNTED, COUNTED_SHARE = 10_000, 25
COMMON = 100_000
#: Weight of a member of a region beside its shingles, so that a bound in weight also bounds the members.
MEMBER = 64
#: Weight (shingles and members, 8 bytes each) over which a region is cut into cells, and that a task holds at most.
CELL, BLOCK = 1 << 22, 1 << 22
#: Shingles that are looked up at once.
SLICE = 1 << 18
#: Pivots of a region that is cut, at least and at most, and how often cells are cut again.
PIVOTS, DEPTH = (8, 64), 4
#: Documents whose prefixes are shuffled at once, about, and passes at most.
PASS, PASSES = 100_000, 8
#: Rows that one file of a staged table of numbers has about, and files that it has at least.
ROWS, FILES = 20_000, 4
#: Documents beyond which ids are joined by shuffling instead of broadcast, and regions over CELL likewise.
BROADCAST_IDS, HEAVY = 500_000, 1000
#: Sizes of sets that are compared together: a little over the widest ratio within the radius, so that two sets within it lie
#: in one band or in two next to each other.
BAND = 1.01 * DENOMINATOR / NUMERATOR
CACHE = 100_000
POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHash()


def shingles(text: str | None) -> np.ndarray:
    """Sorted different 64-bit hashes of the 5-word shingles; under five words, of the whole sequence; else none.

    Words are runs outside space and the five ASCII controls 9-13, with A-Z lower-cased: what bytes.lower().split()
    gives on UTF-8.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(_hashes) > CACHE:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = h[:n] * POWERS[0] + np.uint64(size)
        for k in range(1, size):
            out ^= out >> np.uint64(31)
            out = (out + h[k : k + n]) * POWERS[k]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix(items: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles of which any document within the radius must share at least one.

    All documents put their shingles into the same order, very common ones last. A similar document has three quarters
    of these, so it can miss a quarter of them but not one more.
    """
    n = len(items)
    size = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    if not len(common):
        return items[:size]
    at = np.searchsorted(common, items)
    at[at == len(common)] = 0
    known = common[at] == items
    plain = items[~known]
    if len(plain) >= size:
        return plain[:size]
    late = items[known]
    order = np.lexsort((late, level[at[known]]))
    return np.concatenate([plain, late[order][: size - len(plain)]])


def common_shingles(docs: DataFrame, counted: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several of about `counted` documents, and how common they are (by powers of two), sorted."""
    total = docs.select("doc_id").count()
    counted = max(counted, total // COUNTED_SHARE)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(1_000_000)) / 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["s", "n"])

    some = docs.filter(draw < counted / max(1, total)).select("text").mapInArrow(count, "s long, n long")
    rows = some.groupBy("s").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).collect()
    rows.sort(key=lambda r: r["s"])
    return np.array([r["s"] for r in rows], np.int64), np.array([int(r["n"]).bit_length() for r in rows], np.int64)


def parity_bits(items: np.ndarray) -> bytes:
    """Odd sketch: bit k tells whether an odd number of items hash to k, with 2 to 4 bits an item.

    Items that two sets share cancel out, so two sketches differ in no more bits than the sets differ in items. Half a
    sketch laid over the other half is the sketch of half the width.
    """
    width = max(64, 1 << (2 * len(items) - 1).bit_length())
    odd = np.bincount((items & (width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_shingles, hi, lo, bits, prefix): hash of the text, size and 128-bit digest of the whole set, odd sketch
    and prefix.

    Of equal sets in one task only the first carries sketch and prefix, so a text with many copies doesn't pile up.
    """
    box = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = box.value
        seen: set[int] = set()
        for batch in in_slices(batches):
            sizes, digests, bits, heads = [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text)
                sizes.append(len(items))
                digest = xxhash.xxh128_intdigest(items.tobytes()) if len(items) else None
                digests.append(digest)
                if digest is None or digest in seen:
                    bits.append(None)
                    heads.append(None)
                    continue
                if len(seen) > CACHE:
                    seen.clear()
                seen.add(digest)
                bits.append(parity_bits(items))
                heads.append(prefix(items, common, level))
            half = lambda k: pa.array([None if d is None else (d >> k & (1 << 64) - 1) - (1 << 63) for d in digests], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), half(64), half(0), pa.array(bits, pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
                names=["doc_id", "t", "n_shingles", "hi", "lo", "bits", "prefix"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, n_shingles long, hi long, lo long, bits binary, prefix array<long>")


def files(rows: int) -> int:
    return FILES + rows // ROWS


def seed_regions(heads: DataFrame, total: int) -> DataFrame:
    """(pivot_hi, pivot_lo, hi, lo): for each shingle, the sets with it in their prefix fall into runs of sizes near each other,
    and the set of first rank in a run is a pivot.

    Two sets within the radius share a prefix shingle, and no step between the sizes from one to the other is wider than
    the radius allows, so they share a run, hence a pivot: they meet in its region. Sets that share a shingle by chance
    mostly differ in size, and runs of a single set fall out. Ranks are size and digest, so the sets of one neighbourhood
    agree on few pivots. Rows come sorted by shingle and rank; the scan keeps one pivot at a time and passes over repeated
    rows. The shingles of a large table are taken in passes, each a share of all shingles, so the disk holds the shuffle of
    one pass at a time.
    """
    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passes = min(PASSES, 1 + total // PASS)
    names = ["pivot_hi", "pivot_lo", "hi", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size, pivot = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            x = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
            first = np.concatenate([[s[0] != last], s[1:] != s[:-1]])
            first |= NUMERATOR * n > DENOMINATOR * np.concatenate([[size], n[:-1]])
            starts = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
            pivots = x[starts]
            if pivot is not None:
                pivots[starts < 0] = pivot
            last, size, pivot = s[-1], n[-1], pivots[-1].copy()
            member = ~first & (pivots != x).any(axis=1)
            pairs = np.unique(np.concatenate([pivots[member], x[member]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in range(4)], names=names)

    seeds = []
    for k in range(passes):
        taken = F.filter("prefix", lambda x: F.pmod(x, F.lit(passes)) == k) if passes > 1 else F.col("prefix")
        rows = heads.select(F.explode(taken).alias("s"), F.col("n_shingles").cast("int").alias("n"), "hi", "lo")
        ranked = rows.repartition(max(parts, 2), "s").sortWithinPartitions("s", "n", "hi", "lo")
        seeds.append(stage(ranked.mapInArrow(run, ", ".join(f"{n} long" for n in names)).distinct(), "seeds", files(4 * total)))
    found = reduce(DataFrame.unionByName, seeds)
    found = found.distinct() if passes > 1 else found
    own = found.select("pivot_hi", "pivot_lo", F.col("pivot_hi").alias("hi"), F.col("pivot_lo").alias("lo")).distinct()
    return found.unionByName(own)


def weighed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of regions of two members or more, with their region's members and weight; no region falls to one task."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("members"), F.sum(F.col("n") + MEMBER).alias("weight")).filter("members > 1")
    return join_groups(rows, sizes, key, "members", rows.count())


def spread(rows: DataFrame, limit: int) -> DataFrame:
    """The weighed rows with block numbers i and j: a region over the limit is cut into blocks by hashed member, and every
    two blocks meet under a key of their own; all other regions are one block."""
    blocks = F.ceil(F.col("weight") / limit).cast("int")
    one = rows.filter(F.col("weight") <= limit).withColumns({"i": F.lit(0), "j": F.lit(0)})
    many = rows.filter(F.col("weight") > limit).withColumn("own", F.pmod(F.xxhash64("m", "h"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")
    return one.unionByName(many)


def grouped(frame: DataFrame, key: list[str], values: list[str], work: Callable[..., tuple[np.ndarray, ...]], schema: str, named: bool = False) -> DataFrame:
    """Run work on the columns of each key's rows, one key at a time, many keys a task; `named` puts the key before its results. Numbers come as arrays and
    are never null, all else as lists; work gives arrays of longs."""
    rows = frame.select(*key, *values).repartition(*key).sortWithinPartitions(*key, *values[:2])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []

        def finish() -> None:
            whole = held[0] if len(held) == 1 else [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for p in c for x in p] for c in zip(*held, strict=True)]
            found = work(*whole)
            out.append((*(np.full(len(found[0]), x) for x in last), *found) if named else found)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else c.to_pylist() for c in batch.columns]
            change = np.zeros(batch.num_rows, bool)
            for c in columns[: len(key)]:
                c = np.asarray(c)
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = tuple(c[a] for c in columns[: len(key)])
                if held and name != last:
                    finish()
                last = name
                held.append([c[a:b] for c in columns[len(key) :]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=names)
                out.clear()
        if held:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def hopeful(m: np.ndarray, h: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, ...]:
    """Members of a region that may have another within the radius in it, by size and odd sketch, with their sizes.

    Sets within the radius differ in at most a seventh of their items, (1 - t) / (1 + t) of both sizes together; two
    sketches that differ in more bits rule that out. A member that has found a partner isn't compared any further.
    """
    raw = [np.frombuffer(x, np.uint8) for x in sketches]
    found = np.zeros(len(raw), bool)
    for width in sorted({len(r) for r in raw}):
        # with sets of the same or twice the width: sizes within the radius are never further apart
        pick = np.array([k for k, r in enumerate(raw) if len(r) in (width, 2 * width)])
        if len(pick) < 2:
            continue
        bits = np.stack([folded(raw[k], width) for k in pick])
        size = sizes[pick]
        for k in range(len(pick)):
            if found[pick[k]]:
                continue
            fits = (DENOMINATOR * size >= NUMERATOR * size[k]) & (DENOMINATOR * size[k] >= NUMERATOR * size)
            fits[k] = False
            near = np.flatnonzero(fits)
            if len(near):
                differ = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1, dtype=np.int64)
                good = near[differ * (DENOMINATOR + NUMERATOR) <= (size[near] + size[k]) * (DENOMINATOR - NUMERATOR)]
                if len(good):
                    found[pick[good]] = found[pick[k]] = True
    return m[found], h[found], sizes[found]


def overlaps(one: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with sets laid end to end (none of them empty), SLICE items at a time."""
    hits = np.empty(len(flat), bool)
    for a in range(0, len(flat), SLICE):
        part = flat[a : a + SLICE]
        at = np.searchsorted(one, part)
        at[at == len(one)] = 0
        hits[a : a + SLICE] = one[at] == part
    return np.add.reduceat(hits, starts, dtype=np.int64)


def join_region(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """Component number of each set of a region, two sets being linked when within the radius; `known` has numbers under
    which some are known to be connected.

    One pivot after another is measured against the region: it takes in all within the radius. Then only documents
    outside the largest component can still change anything, so the next pivot is one of these. By the triangle
    inequality a link keeps both ends' distances to any earlier pivot within the radius, which leaves a window of
    documents to measure; documents that are joined with the pivot already or differ too much in size are left out as
    well. Every pair that isn't excluded in one of these ways is measured, so the components are exact.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    component = np.arange(n) if known is None else known.copy()
    if n < 2:
        return component
    ends = np.cumsum(size)
    flat, begins = np.concatenate(sets), ends - size
    done = np.zeros(n, bool)
    seen: list[np.ndarray] = []
    while True:
        counts = np.bincount(component[~done], minlength=n)
        main = int(np.argmax(counts))
        open_ = np.flatnonzero(~done & (component != main))
        if not len(open_):
            break
        pivot = int(open_[0]) if seen else 0
        others = (component != component[pivot]) & ~done
        others &= (DENOMINATOR * size >= NUMERATOR * size[pivot]) & (DENOMINATOR * size[pivot] >= NUMERATOR * size)
        if seen:
            for distance in seen:
                others &= ~(np.abs(distance - distance[pivot]) > RADIUS + 1e-9)
        else:
            others[:] = True
            others[pivot] = False
        near = np.flatnonzero(others)
        if len(near):
            if len(near) > n // 2:
                shared = overlaps(sets[pivot], flat, begins)[near]
            else:
                lengths = size[near]
                starts = np.cumsum(lengths) - lengths
                shared = overlaps(sets[pivot], np.concatenate([sets[k] for k in near]), starts)
            union = size[near] + size[pivot] - shared
            if len(seen) < 4:
                distance = np.full(n, np.nan)
                distance[near], distance[pivot] = 1 - shared / union, 0.0
                seen.append(distance)
            linked = near[DENOMINATOR * shared >= NUMERATOR * union]
            if len(linked):
                merged = np.isin(component, np.append(component[linked], component[pivot]))
                component[merged] = component[pivot]
        elif not seen:
            seen.append(np.full(n, np.nan))
        done[pivot] = True
    return component


def star_edges(m: np.ndarray, h: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges from the first member of each component to its others."""
    _, first, which = np.unique(component, return_index=True, return_inverse=True)
    root = first[which]
    other = np.flatnonzero(root != np.arange(len(root)))
    return m[root[other]], h[root[other]], m[other], h[other]


def region_edges(m: np.ndarray, h: np.ndarray, items: list[bytes], pm: np.ndarray, ph: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of a region or cell; inner members that are linked to one group of pivots (pm, ph) are connected already."""
    known, at = np.arange(len(m)), np.flatnonzero(inner)
    if len(at):
        _, first, which = np.unique(np.stack([pm[at], ph[at]], axis=1), axis=0, return_index=True, return_inverse=True)
        known[at] = at[first[which.ravel()]]
    return star_edges(m, h, join_region([np.frombuffer(x, np.int64) for x in items], known))


MEASURED = "pivot_hi long, pivot_lo long, path string, m long, h long, n long, items binary, members long, weight long, cell int, into array<int>, pm long, ph long"


def measure(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Some members of a region against the pivots of the whole region: Voronoi cell, windows, group.

    A member's cell is that of its nearest pivot (ties: the first pivot). `into` has the cells of earlier pivots from which
    it is at most twice the radius further than from its own: by the triangle inequality no member at home elsewhere is
    within the radius of it, so of any two members within the radius one comes into the home of the other. A member within
    the radius of its nearest pivot gets that pivot's group (pm, ph): pivots that are linked among themselves are one group,
    named by its first pivot. Without pivots there is one cell.
    """
    sets = [np.frombuffer(x, np.int64) for x in members["items"].to_pylist()]
    order = np.lexsort((pivots["h"].to_numpy(), pivots["m"].to_numpy()))
    centres = [np.frombuffer(x, np.int64) for x in pivots["items"].take(pa.array(order)).to_pylist()]
    names = [pivots[c].to_numpy()[order] for c in ("m", "h")]
    cell, into, group = np.zeros(len(sets), np.int64), [[] for _ in sets], np.full(len(sets), -1)
    if centres and sets:
        size, rows = np.array([len(x) for x in sets]), np.arange(len(sets))
        flat, starts = np.concatenate(sets), np.cumsum(size) - size
        shared = np.stack([overlaps(c, flat, starts) for c in centres], axis=1)
        union = size[:, None] + np.array([len(c) for c in centres]) - shared
        distance = 1 - shared / union
        cell = distance.argmin(axis=1)
        near = (distance <= distance[rows, cell][:, None] + 2 * RADIUS + 1e-9) & (np.arange(len(centres)) < cell[:, None])
        into = [np.flatnonzero(x) for x in near]
        _, first, which = np.unique(join_region(centres), return_index=True, return_inverse=True)
        within = DENOMINATOR * shared[rows, cell] >= NUMERATOR * union[rows, cell]
        group = np.where(within, first[which][cell], -1)
    own = [pa.array(np.where(group >= 0, n[group], 0) if len(n) else np.zeros(len(sets), np.int64), pa.int64(), mask=group < 0) for n in names]
    kept = ("pivot_hi", "pivot_lo", "path", "m", "h", "n", "items", "members", "weight")
    return pa.table([members[c] for c in kept] + [pa.array(cell, pa.int32()), pa.array(into, pa.list_(pa.int32())), *own], names=[*kept, "cell", "into", "pm", "ph"])


def cells(regions: DataFrame, depth: int) -> DataFrame:
    """Cut weighed regions (pivot_hi, pivot_lo, path, m, h, n, items, members, weight) into the cells of their own pivots:
    one row for each member and cell that it is at home in or comes into, with `home`, its group and the cell's path.

    Pivots are drawn among a region's members by hash, two for each CELL of weight within the bounds PIVOTS. A region's
    members are dealt to as many tasks as it has CELLs, and its pivots go to each of these. A member of a group doesn't
    come into a cell whose members are all of that group, since these are connected with it already; so a dense region of
    near copies is measured against its pivots and nothing else. Where members are so far from all pivots that their windows
    would take more copies of them than blocks that meet pairwise, the region stays one cell.
    """
    key = ["pivot_hi", "pivot_lo", "path"]
    parts = F.ceil(F.col("weight") / CELL).cast("int")
    dealt = regions.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("m", "h"), parts).cast("int")})
    wanted = F.least(F.greatest(2 * F.col("parts"), F.lit(PIVOTS[0])), F.lit(PIVOTS[1]))
    draw = F.pmod(F.xxhash64("m", "h", F.lit(depth)), F.lit(1_000_000)) / 1_000_000
    drawn = dealt.filter(draw < wanted / F.col("members")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = dealt.select(*key, "part", "m", "h", "n", "items", "members", "weight"), drawn.select(*(F.col(c).alias(f"pivot_{c}") for c in (*key, "part", "m", "h", "items")))
    work = lambda a, b: measure(a, b.select(["pivot_m", "pivot_h", "pivot_items"]).rename_columns(["m", "h", "items"]))
    measured = stage(left.groupBy(*key, "part").cogroup(right.groupBy(*(f"pivot_{c}" for c in (*key, "part")))).applyInArrow(work, MEASURED).filter("m is not null"), "measured", above=1)
    group = F.struct("pm", "ph")
    alike = measured.groupBy(*key, "cell").agg(F.count("*").alias("all"), F.count("pm").alias("inner"), F.min(group).alias("low"), F.max(group).alias("high"))
    # at most PIVOTS cells a region
    one = F.when((F.col("inner") == F.col("all")) & (F.col("low") == F.col("high")), F.struct("cell", F.col("low.pm").alias("pm"), F.col("low.ph").alias("ph")))
    single = alike.groupBy(*key).agg(F.sum("all").alias("all"), F.collect_list(one).alias("single"))
    met = join_groups(measured, single, key, "all", measured.count())
    same = lambda c: F.exists("single", lambda x: (x["cell"] == c) & x["pm"].eqNullSafe(F.col("pm")) & x["ph"].eqNullSafe(F.col("ph")))
    met = met.withColumn("to", F.concat(F.array("cell"), F.filter("into", lambda c: ~same(c))))
    loose = met.groupBy(*key).agg(F.sum((F.col("n") + MEMBER) * F.size("to")).alias("copied"), F.first("weight").alias("whole"))
    # at most one region for each CELL of weight
    loose = loose.filter(F.col("copied") > F.col("whole") * F.greatest(F.lit(2), F.ceil(F.col("whole") / BLOCK))).select(*key, F.lit(True).alias("loose"))
    met = met.join(F.broadcast(loose), key, "left").withColumn("cell", F.when(F.col("loose"), F.lit(-1)).otherwise(F.col("cell")))
    placed = met.withColumn("at", F.explode(F.when(F.col("loose"), F.array("cell")).otherwise(F.col("to"))))
    return placed.select("pivot_hi", "pivot_lo", F.concat_ws("/", "path", "at").alias("path"), "m", "h", "n", "items", "weight", (F.col("at") == F.col("cell")).alias("home"), "pm", "ph")


def region_links(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """(am, ah, bm, bh): edges that connect all members of weighed regions which are connected within the radius, given the
    members' sets (m, h, items).

    Regions over CELL are cut into Voronoi cells, and cells again as long as that makes them smaller by a fifth, DEPTH times
    at most; what is still over BLOCK is cut into blocks that meet pairwise. A cell whose members all belong to one group
    of linked pivots has nothing left to compare.
    """
    key = ["pivot_hi", "pivot_lo", "path"]
    none = F.lit(None).cast("long")
    whole = lambda some: some.join(sets.select("m", "h", "items"), ["m", "h"]).withColumn("path", F.lit(""))
    small, large = regions.filter(F.col("weight") <= CELL), regions.filter(F.col("weight") > CELL)
    if large.isEmpty():
        large = None
    else:
        sets = stage(sets, "sets")
        large = whole(large)
    done, edges = [whole(small).withColumns({"pm": none, "ph": none})], []
    for depth in range(DEPTH):
        if large is None or (depth and large.isEmpty()):
            break
        cut = cells(large, depth)
        edges.append(cut.filter("home and pm is not null").select(F.col("pm").alias("am"), F.col("ph").alias("ah"), F.col("m").alias("bm"), F.col("h").alias("bh")))
        group = F.struct("pm", "ph")
        sizes = cut.groupBy(*key).agg(
            F.count("*").alias("members"), F.sum(F.col("n") + MEMBER).alias("now"), F.count("pm").alias("inner"), (F.min(group) != F.max(group)).alias("several"),
        ).filter("members > 1 and (inner < members or several)")
        met = join_groups(cut, sizes, key, "members", cut.count()).drop("inner", "several", "home")
        again = (F.col("now") > CELL) & (F.col("now") < 0.8 * F.col("weight")) & F.lit(depth + 1 < DEPTH)
        met = met.withColumn("again", again).drop("weight").withColumnRenamed("now", "weight")
        done.append(met.filter(~F.col("again")).drop("again"))
        large = met.filter("again").drop("again", "pm", "ph")
    inner = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pm", "ph")] + [F.col("pm").isNotNull().cast("int").alias("inner")]
    ready = reduce(DataFrame.unionByName, (spread(d.select(*key, "m", "h", "items", *inner, "weight"), BLOCK) for d in done))
    found = grouped(ready, [*key, "i", "j"], ["m", "h", "items", "pm", "ph", "inner"], region_edges, "am long, ah long, bm long, bh long")
    return reduce(DataFrame.unionByName, [found, *edges]).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component of the edges (a, b), for every node on an edge.

    Labels fall to the smallest among the neighbours' labels, then to the label of the label, until nothing changes;
    jumping makes the rounds few. Every round is written to the shared folder, so lost executors repeat one round. Nodes
    with very many edges get their labels by broadcast (join_groups), so none falls to one task.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("to"))
    total = edges.count()
    labels = stage(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label"), F.count("*").alias("degree")), "labels", files(total))
    while True:
        # each edge carries its start's label to its end
        sent = join_groups(both, labels, "node", "degree", 2 * total).groupBy(F.col("to").alias("node")).agg(F.min("label").alias("sent"))
        lower = labels.join(sent, "node").select("node", F.least("label", "sent").alias("low"), F.col("label").alias("old"), "degree")
        # how many nodes have a label: a label that many share is broadcast like a node of many edges
        shared = lower.groupBy("low").agg(F.count("*").alias("sharing"))
        jump = shared.join(labels.select(F.col("node").alias("low"), F.col("label").alias("jump")), "low")
        moved = F.least("low", "jump")
        fresh = stage(join_groups(lower, jump, "low", "sharing", 2 * total).select("node", moved.alias("label"), "degree", (moved != F.col("old")).alias("moved")), "labels", files(total))
        if fresh.filter("moved").isEmpty():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label", "degree")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(m, h, n, items): whole shingle sets of the wanted members (m, h): document and first half of its set's digest.

    Ids are broadcast only where their count allows. A document id with several texts gives a set for each.
    """
    ids = wanted.select(F.col("m").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            first = [(xxhash.xxh128_intdigest(s.tobytes()) >> 64) - (1 << 63) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["m", "h", "n", "items"]
            )

    found = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "m long, h long, n long, items binary")
    return found.join(wanted, ["m", "h"], "left_semi").dropDuplicates(["m", "h"])


def possible(members: DataFrame) -> DataFrame:
    """(pivot_hi, pivot_lo, m, h, n): members of regions (pivot_hi, pivot_lo, m, h, n, bits) that may have another within the
    radius in theirs, by size and odd sketch.

    A region over CELL is cut into bands of sizes, each of which also takes in the band before it, and a band over BLOCK into
    blocks that meet pairwise. Only sketches are copied for that, whole sets are not.
    """
    key = ["pivot_hi", "pivot_lo"]
    heavy = members.groupBy(*key).agg(F.sum(F.col("n") + MEMBER).alias("weight")).filter(F.col("weight") > CELL).select(*key)
    number = heavy.count()
    heavy = F.broadcast(heavy) if number <= HEAVY else heavy
    light = members.join(heavy, key, "left_anti") if number else members
    schema = ", ".join(f"{c} long" for c in (*key, "m", "h", "n"))
    live = grouped(light, key, ["m", "h", "n", "bits"], hopeful, schema, named=True)
    if not number:
        return live
    own = F.floor(F.ln("n") / math.log(BAND)).cast("int")
    banded = members.join(heavy, key, "left_semi").withColumn("band", F.explode(F.array(own, own + 1)))
    inner = [*key, "band"]
    ready = spread(weighed(banded, inner), BLOCK)
    # a member may be found in both of its bands and in several blocks
    found = grouped(ready, [*inner, "i", "j"], ["m", "h", "n", "bits"], hopeful, ", ".join(f"{c} long" for c in (*inner, "i", "j", "m", "h", "n")), named=True)
    return live.unionByName(found.select(*key, "m", "h", "n").distinct())


def set_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, t, n_shingles, hi, lo) of the documents, and (hi, lo, size, m, h, t, label) of each different set: how many
    documents have it, its member (smallest document and first half of the digest), that document's text by hash, and the
    smallest member that is reachable by links; and the number of documents with a set. What else is staged goes as soon as
    it is used up; cells of large regions go with the scratch() around."""
    spark, key = docs.sparkSession, ["pivot_hi", "pivot_lo"]
    with scratch(spark):
        with scratch(spark):
            with scratch(spark):
                wide = stage(sketch(docs), "sketch")
                rows = stage(wide.drop("bits", "prefix"), "rows", above=3)
                full = rows.filter("hi is not null and doc_id is not null")
                first = F.min(F.struct("doc_id", "t"))
                groups = full.groupBy("hi", "lo").agg(first.alias("first"), F.count("*").alias("size"), F.first("n_shingles").alias("n"))
                groups = groups.select("hi", "lo", F.col("first.doc_id").alias("m"), F.col("hi").alias("h"), F.col("first.t").alias("t"), "size", "n")
                groups = stage(groups, "classes", above=2)
                total = groups.agg(F.sum("size")).first()[0] or 0
                heads = wide.filter("prefix is not null and doc_id is not null")
                bits = heads.select("hi", "lo", "bits").join(groups.select("hi", "lo", "m", "n"), ["hi", "lo"]).dropDuplicates(["hi", "lo"])
                met = seed_regions(heads, total).join(bits, ["hi", "lo"])
                members = stage(met.select(*key, "m", F.col("hi").alias("h"), "n", "bits"), "regions", files(4 * total), above=1)
            live = stage(possible(members), "live", above=1)
        regions = stage(weighed(live, key), "weighed", files(total))
        links = stage(region_links(regions, shingle_sets(docs, regions.select("m", "h").distinct())), "links", files(total))
        labels = classes(links.select(F.struct(F.col("am").alias("m"), F.col("ah").alias("h")).alias("a"), F.struct(F.col("bm").alias("m"), F.col("bh").alias("h")).alias("b")))
        own = groups.select("hi", "lo", "size", "m", "h", "t", F.struct("m", "h").alias("node"))
        labelled = own.join(labels, "node", "left").select("hi", "lo", "size", "m", "h", "t", F.coalesce("label", "node").alias("label"))
        labelled = stage(labelled, "labelled", files(total), above=1)
    return rows, labelled, total


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): set size and smallest doc_id reachable by links, for each document.

    Documents link when their 5-word shingle sets have a Jaccard similarity of 0.75 or more. Documents without words
    have no shingles and link with nothing. Documents with equal sets are one class, represented by its smallest id and
    its digest, so copies never meet each other and two texts under one id stay two; their class is joined back by
    broadcast for the few largest classes (join_groups) and by shuffling for the others. Null ids: such rows link with
    nothing and get a null component. Repeated rows share their class. Empty table: no rows. Columns other than doc_id and
    text are not read.
    """
    rows, labelled, total = set_classes(docs)
    full = rows.filter("hi is not null and doc_id is not null").select("doc_id", "n_shingles", "hi", "lo")
    joined = join_groups(full, labelled, ["hi", "lo"], "size", total).select("doc_id", "n_shingles", F.col("label.m").alias("component_id"))
    alone = rows.filter("hi is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest id, with all its columns, whatever their names.

    Rows with the same id and text are one document; different texts of one id are judged each for itself. Rows without an
    id link with nothing and all stay, and so do documents without words. The one shuffle of the texts, by id and hash of
    the text, serves the join and the cut of repeated rows.
    """
    named = docs.filter("doc_id is not null")
    rows, labelled, _ = set_classes(named)
    first = labelled.filter((F.col("label.m") == F.col("m")) & (F.col("label.h") == F.col("h"))).select(F.col("m").alias("doc_id"), "t")
    found = first.unionByName(rows.filter("hi is null").select("doc_id", "t"))
    id_, mark = free_name(docs, "id"), free_name(docs, "text")
    keys = found.select(F.col("doc_id").alias(id_), F.col("t").alias(mark))
    marked = named.withColumns({id_: F.col("doc_id"), mark: F.xxhash64("text")})
    kept = marked.join(keys, [id_, mark], "left_semi").dropDuplicates([id_, mark]).drop(id_, mark)
    return kept.unionByName(docs.filter("doc_id is null"))
