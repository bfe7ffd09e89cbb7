"""Persistent text index: posting blocks with their peaks, searched with upper bounds instead of a scan of the corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.vectors import pieces
from lexmill.operators.retrieval import CELLS, K1, TERM_BLOCK, B, BestRows, half_up_array, query_blocks, ranked
from lexmill.session import scratch, shared_dir, shuffles_removed, stage

#: Documents of a slice: the blocks of all terms are cut at the same documents, so bounds of a slice add up.
SLICE = 32
BUCKETS = 16
#: Tasks that the blocks of one bucket are dealt to, by slice, so that a very common term falls to several.
SPREAD = 8
#: Slices of highest bound that are scored first for each query; they give the score that others must reach.
SEEDS = 4
#: Slices up to which their numbers are broadcast to leave out the blocks of all others before the shuffle.
BROADCAST_SLICES = 500_000
#: Words of the documents that are cut into slices together, about.
DOCUMENT_ITEMS = 500_000
#: Scores are rounded to six digits, so a bound may fall short by half of one.
SLACK = 1e-6


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of consecutive values, given where each ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number of each item of a list column, and the items."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def peaks(block: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """Places of the postings that can have the highest weight of their block under some mean length: those that no other
    beats in both count and length. Blocks are numbered upwards from 0."""
    order = np.lexsort((dl, -tf, block))
    length, number = dl[order].astype(np.int64), block[order].astype(np.int64)
    reach = int(length.max(initial=0)) + 1
    least = np.minimum.accumulate(length - number * reach)
    first = np.diff(number, prepend=-1) > 0
    return order[first | (length - number * reach < np.concatenate([[0], least[:-1]]))]


def alike(row: np.ndarray, code: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
    """Order of documents by their commonest word, then by length."""
    pair, count = np.unique(row * wide + code, return_counts=True)
    doc, word = np.divmod(pair, wide)
    best = np.lexsort((word, -count, doc))
    first = best[np.diff(doc[best], prepend=-1) > 0]
    common = np.full(len(size), -1)
    common[doc[first]] = word[first]
    return np.lexsort((size, common))


def build_blocks(batches: Iterator[pa.RecordBatch], number: int, slice_: int) -> Iterator[pa.RecordBatch]:
    """Rows of one batch of documents, from (key, bag): for each slice its keys and lengths (term null), and for each term
    in it the places within the slice, counts and peaks.

    Documents that come in one piece of an Arrow batch are put in order by their commonest word, then by length, before they are cut
    into slices: documents alike share a slice, so its bounds lie close to what its documents reach.
    """
    part, seq = TaskContext.get().partitionId(), 0
    for batch in pieces(batches, 1, DOCUMENT_ITEMS):
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        bags = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
        size = pc.list_value_length(bags).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(bags.flatten())
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        wide = max(1, len(words))
        order = alike(row, code, size, wide)
        keys, size = keys[order], size[order]
        row = np.argsort(order)[row]
        both, tf = np.unique(((row // slice_) * wide + code) * slice_ + row % slice_, return_counts=True)
        pair, at = np.divmod(both, slice_)
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        block = np.cumsum(np.diff(pair, prepend=-1) > 0) - 1
        group, term = np.divmod(pair[heads], wide)
        top = np.sort(peaks(block, tf, size[(pair // wide) * slice_ + at]))
        groups = -(-len(size) // slice_)
        ids = (number << 44) | (part << 22) | (seq + np.arange(groups))
        seq += groups
        ends = np.append(heads[1:], len(both)) if len(heads) else heads
        tops = np.cumsum(np.bincount(block[top], minlength=len(heads))) if len(heads) else heads
        starts = np.arange(0, len(size), slice_)
        none = lambda n, kind: pa.nulls(n, pa.list_(kind))
        names = ["slice", "term", "keys", "lengths", "at", "tf", "peak_tf", "peak_dl"]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids), pa.nulls(groups, pa.string()), lists(np.append(starts[1:], len(size)), keys, pa.int64()),
            lists(np.append(starts[1:], len(size)), size, pa.int32()), *(none(groups, pa.int32()) for _ in range(4)),
        ], names=names)
        if len(heads):
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[group]), words.take(pa.array(term)), none(len(heads), pa.int64()), none(len(heads), pa.int32()), lists(ends, at, pa.int32()), lists(ends, tf, pa.int32()),
                lists(tops, tf[top], pa.int32()), lists(tops, size[(pair // wide) * slice_ + at][top], pa.int32()),
            ], names=names)


class PostingsIndex:
    """A folder of posting blocks that grows batch by batch and outlives the session.

    postings/batch=B/bucket=N holds (term, slice, n, at, tf, peak_tf, peak_dl), sorted by term, so a search reads the
    buckets of its terms and skips row groups; slices/batch=B holds (slice, n, tokens, keys, lengths). Counts are the
    corpus' statistics: they are summed over batches when they are needed, so a batch changes no earlier file. The slices
    are written last: a batch that failed before is not seen, and one given again overwrites itself.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, slice_: int = SLICE):
        self.spark, self.buckets, self.slice = spark, buckets, slice_
        self.path = (path or f"{shared_dir(spark)}/lexmill/postings-{uuid.uuid4().hex}").rstrip("/")

    def append(self, docs: DataFrame, tokens: Column, batch: int, key: str = "doc_id") -> None:
        """Take in documents under the batch's number; keys are not checked against earlier batches."""
        slice_ = self.slice
        made = docs.select(F.col(key).cast("long"), tokens.alias("bag")).mapInArrow(
            lambda b: build_blocks(b, batch, slice_), "slice long, term string, keys array<long>, lengths array<int>, at array<int>, tf array<int>, peak_tf array<int>, peak_dl array<int>"
        )
        with scratch(self.spark):
            made = stage(made, "posting-blocks")
            blocks = made.filter("term is not null").select("term", "slice", F.size("at").alias("n"), "at", "tf", "peak_tf", "peak_dl", bucket(F.col("term"), self.buckets).alias("bucket"))
            placed = blocks.repartition("bucket", F.pmod(F.xxhash64("slice"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "slice")
            with shuffles_removed(self.spark):
                placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
            slices = made.filter("term is null").select("slice", F.size("keys").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), "keys", "lengths")
            slices.write.mode("overwrite").parquet(f"{self.path}/slices/batch={batch}")

    def batches(self) -> list[int]:
        """Numbers of the finished batches."""
        java = self.spark._jvm.org.apache.hadoop.fs
        root = java.Path(f"{self.path}/slices")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(root) if files.exists(java.Path(s.getPath(), "_SUCCESS")))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/batch={b}" for b in self.batches()]
        reader = self.spark.read.schema(schema)
        return reader.option("basePath", f"{self.path}/{part}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def postings(self) -> DataFrame:
        return self._read("postings", "term string, slice long, n int, at array<int>, tf array<int>, peak_tf array<int>, peak_dl array<int>, bucket int")

    def slices(self) -> DataFrame:
        return self._read("slices", "slice long, n int, tokens long, keys array<long>, lengths array<int>")

    def frequencies(self) -> DataFrame:
        """(term, df) over all batches, from the counts of the blocks alone."""
        return self.postings().groupBy("term").agg(F.sum("n").alias("df"))


def impact(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class _Block:
    """Queries that go to the workers together: ids, their terms, and who has each term."""

    def __init__(self, rows: list):
        held: dict[int, list[str]] = {}
        for query, token in rows:
            held.setdefault(query, []).append(token)
        self.ids = np.array(sorted(held), np.int64)
        self.terms = sorted({t for ts in held.values() for t in ts})
        number = {t: i for i, t in enumerate(self.terms)}
        having: dict[int, list[int]] = {}
        for q, i in enumerate(self.ids.tolist()):
            for t in set(held[i]):
                having.setdefault(number[t], []).append(q)
        self.having = {t: np.array(qs) for t, qs in having.items()}
        self.idf = np.zeros(len(self.terms))
        self.mean = 1.0


def slice_bounds(batches: Iterator[pa.RecordBatch], block: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slices, bound, postings): matrices of queries x slices, from rows of (slice, no, n, peak_tf, peak_dl), the last two as
    lists of lists."""
    width = max(1, CELLS // (2 * len(block.ids)))
    for whole in pieces(batches, 1):
        for at in range(0, whole.num_rows, width):
            batch = whole.slice(at, width)
            row, term = flat(batch.column(1))
            n = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            inner_tf, inner_dl = batch.column(3).flatten(), batch.column(4).flatten()
            which, tf = flat(inner_tf)
            weight = impact(tf, inner_dl.flatten().to_numpy(zero_copy_only=False), block.mean)
            most = np.zeros(len(term))
            np.maximum.at(most, which, weight)
            bound, count = np.zeros((len(block.ids), batch.num_rows)), np.zeros((len(block.ids), batch.num_rows), np.int64)
            order = np.argsort(term, kind="stable")
            cuts = np.flatnonzero(np.diff(term[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = order[a:b]
                t = int(term[some[0]])
                cells = np.ix_(block.having[t], row[some])
                bound[cells] += block.idf[t] * most[some]
                count[cells] += n[some]
            yield batch.column(0).to_numpy(zero_copy_only=False), bound, count


TARGET = "slice long, queries array<int>, postings array<long>"


def _score(index: PostingsIndex, targets: DataFrame, wanted: DataFrame, box, k: int, key: str) -> DataFrame:
    """(query_id, key, score): the k best of each query in the slices that are named for it.

    The slices' keys and lengths are written beside their queries first, so the blocks, which are many, are in no join: each is
    shuffled once for all queries, to where its slice is. Blocks of other slices are left out before, or passed over where
    even the slices' numbers are too many to be broadcast. A task goes through its slices in order and keeps k rows a query.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = targets.join(index.slices().select("slice", "keys", "lengths"), "slice").select("slice", F.lit(-1).alias("no"), "keys", F.col("lengths").alias("a"), F.col("queries").alias("b"))
    heads = stage(heads, "slice-heads")
    blocks = wanted.select("slice", "no", none("array<bigint>").alias("keys"), F.col("at").alias("a"), F.col("tf").alias("b"))
    if heads.count() <= BROADCAST_SLICES:
        blocks = blocks.join(F.broadcast(heads.select("slice")), "slice", "left_semi")
    rows = heads.unionByName(blocks).repartition("slice").sortWithinPartitions("slice", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = box.value, BestRows(k)
        keys = lengths = queries = score = here = None

        def close() -> None:
            if queries is not None:
                full = np.zeros((len(block.ids), len(keys)))
                full[queries] = score
                best.add(half_up_array(full), keys, 0.0)

        for batch in batches:
            for slice_, no, key_list, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
                if no < 0:
                    close()
                    here = slice_
                    keys, lengths, queries = (x.values.to_numpy(zero_copy_only=False) for x in (key_list, a, b))
                    place = np.full(len(block.ids), -1)
                    place[queries] = np.arange(len(queries))
                    score = np.zeros((len(queries), len(keys)))
                elif slice_ == here:
                    mine = place[block.having[no]]
                    mine = mine[mine >= 0]
                    if len(mine):
                        at, tf = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                        score[np.ix_(mine, at)] += block.idf[no] * impact(tf, lengths[at], block.mean)
        close()
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[best.query]), pa.array(best.key), pa.array(best.score)], names=["query_id", key, "score"])

    return rows.mapInArrow(run, f"query_id long, {key} long, score double")


def postings_top_k(index: PostingsIndex, queries: DataFrame, k: int, key: str = "doc_id", seeds: int = SEEDS, report: dict[str, int] | None = None) -> DataFrame:
    """(query_id, key, score, rank): what bm25_top_k() gives over all documents of the index, without reading the documents.

    A query's bound in a slice is the sum of its terms' highest weights there, from the peaks, which hold for any mean
    length. The `seeds` slices of highest bound are scored first; their k-th score is what any other document must reach,
    so of the other slices only those whose bound reaches it are scored. Nothing is lost: a document's score never exceeds
    its slice's bound. Queries go out in blocks of about TERM_BLOCK words. `report` takes the numbers of postings that the
    queries have (`postings`) and of those that were scored (`scored`). Empty index or query set: no rows.
    """
    spark, out = index.spark, None
    total, tokens = index.slices().agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    for condition in query_blocks(queries, F.lit(1), TERM_BLOCK):
        block = _Block([tuple(r) for r in queries.filter(condition).select(F.col("query_id").cast("long"), "token").collect()])
        if not len(block.ids) or not total:
            continue
        # at most TERM_BLOCK words
        terms = spark.createDataFrame([(t, i) for i, t in enumerate(block.terms)], "term string, no int")
        named = terms.withColumn("bucket", bucket(F.col("term"), index.buckets))
        needed = [r[0] for r in named.select("bucket").distinct().collect()]
        with scratch(spark):
            wanted = index.postings().filter(F.col("bucket").isin(needed)).join(F.broadcast(terms), "term")
            light = wanted.groupBy("slice").agg(F.collect_list(F.struct("no", "n", "peak_tf", "peak_dl")).alias("x"))
            light = stage(light.select("slice", *(F.col(f"x.{c}").alias(c) for c in ("no", "n", "peak_tf", "peak_dl"))), "slice-peaks")
            df = np.zeros(len(block.terms))
            for no, n in light.select(F.explode(F.arrays_zip("no", "n")).alias("x")).groupBy("x.no").agg(F.sum("x.n")).collect():
                df[no] = n
            block.idf, block.mean = np.log(1 + (total - df + 0.5) / (df + 0.5)), tokens / total or 1.0
            box = spark.sparkContext.broadcast(block)

            def first(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
                best, block = BestRows(seeds), box.value
                for slices, bound, _ in slice_bounds(batches, block):
                    best.add(bound, slices, 0.0)
                if len(best.query):
                    yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.key), pa.array(best.score)], names=["q", "slice", "score"])

            # at most `seeds` rows a query of the block
            begun = ranked(light.mapInArrow(first, "q long, slice long, score double"), "q", F.desc("score"), F.asc("slice"), k=seeds).select("q", "slice").collect()
            of_slice: dict[int, list[int]] = {}
            for q, s in begun:
                of_slice.setdefault(s, []).append(q)
            seeded = spark.createDataFrame([(s, sorted(qs)) for s, qs in sorted(of_slice.items())], "slice long, queries array<int>")
            early = stage(ranked(_score(index, seeded, wanted, box, k, key), "query_id", F.desc("score"), F.asc(key), k=k), "seed-scores")
            reach = np.full(len(block.ids), -np.inf)
            for query, score in early.filter(F.col("rank") == k).select("query_id", "score").collect():
                reach[np.searchsorted(block.ids, query)] = score
            second = spark.sparkContext.broadcast((reach, of_slice))

            def rest(batches: Iterator[pa.RecordBatch], box=box, second=second) -> Iterator[pa.RecordBatch]:
                reach, done = second.value
                for slices, bound, count in slice_bounds(batches, box.value):
                    live = (bound > 0) & (bound + SLACK >= reach[:, None])
                    for j, s in enumerate(slices.tolist()):
                        live[done.get(s, []), j] = False
                    column, query = np.nonzero(live.T)
                    ends = np.searchsorted(column, np.arange(len(slices)), side="right")
                    full = np.flatnonzero(np.diff(ends, prepend=0))
                    yield pa.RecordBatch.from_arrays([pa.array(slices[full]), lists(ends[full], query, pa.int32()), lists(ends[full], count.T[column, query], pa.int64())], names=["slice", "queries", "postings"])

            late = stage(light.mapInArrow(rest, TARGET), "slices-left")
            if report is not None:
                _report(report, light, late, block, of_slice)
            one = early.select("query_id", key, "score").unionByName(_score(index, late.select("slice", "queries"), wanted, box, k, key))
            one = stage(ranked(one, "query_id", F.desc("score"), F.asc(key), k=k), "found", above=1)
        box.destroy()
        second.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")


def _report(report: dict[str, int], light: DataFrame, late: DataFrame, block: _Block, of_slice: dict[int, list[int]]) -> None:
    pairs = light.select("slice", F.explode(F.arrays_zip("no", "n")).alias("x")).select("slice", "x.no", "x.n")
    having = light.sparkSession.createDataFrame([(t, qs.tolist()) for t, qs in block.having.items()], "no int, qs array<int>")
    seeds = light.sparkSession.createDataFrame([(s, qs) for s, qs in of_slice.items()], "slice long, queries array<int>")
    both = pairs.join(having, "no").join(seeds, "slice", "left")
    counted = both.agg(F.sum(F.col("n") * F.size("qs")), F.sum(F.when(F.col("queries").isNotNull(), F.col("n") * F.size(F.array_intersect("qs", "queries"))).otherwise(0))).first()
    left = late.agg(F.sum(F.aggregate("postings", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    report["postings"] = report.get("postings", 0) + (counted[0] or 0)
    report["scored"] = report.get("scored", 0) + (counted[1] or 0) + left
