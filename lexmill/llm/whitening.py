"""Operator 12: whitening of embeddings by a randomised range finder with Rayleigh-Ritz."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import in_slices
from lexmill.session import stage

#: Entries are counted in units of 1 / SCALE.
SCALE = 256.0
COMPONENTS = 4
#: Columns of the range finder beyond the components asked for, and power passes before it goes to full dimension.
OVERSAMPLING, POWER = 8, 3
#: An eigenvalue at most this share of the largest, times the dimension, is zero.
ZERO = float(np.finfo(np.float64).eps)
SEED = 20240607
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """Fit of one dimension: n vectors, their sums, the trace of their covariance V, unit eigenvectors of V as columns,
    eigenvalues, and whether the range finder had to go to full dimension."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    full: bool
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(vector: Column) -> Column:
    """floor(256 c) of each entry as a long; what a long can't hold becomes the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and every entry is a finite number."""
    double = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(double(c)) | (F.abs(double(c)) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column, whose lists are all of one size."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def row_sums(rows: DataFrame, size: int, wide: int, part) -> np.ndarray:
    """Sum over all rows of part(x), a (size, wide) matrix for a block x of rows.

    Each task adds up its own blocks and sends `size` rows of `wide` numbers; the rows with one number are added as a
    stream in one task each, so neither a task nor the driver holds more than a few such matrices.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in in_slices(batches, 8192):
            if batch.num_rows:
                block = part(matrix(batch.column(0), size))
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1), wide), strict=True):
                totals[i] = totals[i] + v if i in totals else v.copy()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["i", "v"])

    sums = rows.select("x").mapInArrow(local, "i long, v array<double>").repartition("i").mapInArrow(merged, "i long, v array<double>")
    out = np.zeros((size, wide))
    for row in sums.collect():
        out[row["i"]] = row["v"]
    return out


def long_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each entry.

    Each entry is split at 2^32, so the sums of both halves stay within longs and doubles don't come into it.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), size)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array([n] * size), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    found = rows.select("x").mapInArrow(local, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high").alias("high"), exact("low").alias("low")).collect()
    sums = [0] * size
    for row in found:
        sums[row["i"]] = (int(row["high"]) << 32) + int(row["low"])
    return (found[0]["n"] if found else 0), sums


def range_finder(times, size: int, components: int, oversampling: int = OVERSAMPLING, power: int = POWER) -> tuple[np.ndarray, np.ndarray, bool]:
    """(eigenvalues, eigenvectors as columns, went to full dimension) of a symmetric matrix known by its products times(Q).

    Gaussian test vectors, `oversampling` more than components, are multiplied by the matrix and made orthogonal; each
    further pass raises the power. After each product Rayleigh-Ritz gives vectors; they are taken when their residuals are
    as small as rounding leaves them in a dense solver. If no pass gets there, the basis grows to the full dimension,
    where Rayleigh-Ritz is exact.
    """
    eps = np.finfo(np.float64).eps
    wide = min(size, components + oversampling)
    basis = np.eye(size) if wide == size else np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, wide)))[0]
    for turn in range(power + 2):
        if turn == power + 1 or basis.shape[1] == size:
            basis = np.eye(size)
        image = times(basis)
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, inner = values[order], inner[:, order]
        vectors = basis @ inner
        if basis.shape[1] == size:
            return values, vectors, True
        residual = np.linalg.norm(image @ inner - vectors * values, axis=0)
        if turn and (residual[:components] <= 4 * np.sqrt(size) * eps * values[0]).all():
            return values, vectors, False
        basis = np.linalg.qr(image)[0]
    raise AssertionError("the full dimension always ends it")


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit over the distinct vectors x of one dimension, all of them in every pass; None if there are no rows.

    Each pass is one Spark job over the written fit list: rows are centred before they are multiplied, and only matrices
    of `size` times the basis come back.
    """
    n, sums = long_sums(rows, size)
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def times(basis: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ basis)

        def square(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ centred

        return row_sums(rows, size, basis.shape[1], square if basis.shape[0] == basis.shape[1] else part) / n

    trace = float(row_sums(rows, size, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum() / n)
    values, vectors, full = range_finder(times, size, min(components, size))
    top = int(np.sum(values[:components] > ZERO * size * max(values[0], 0.0)))
    found = Whitening(n, sums, trace, vectors[:, :top], values[:top], full)
    if top:
        found.identity_error = identity_error(rows, size, found)
    return found


def identity_error(rows: DataFrame, size: int, found: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, from one more pass."""
    mean, turn = found.mean, found.vectors / np.sqrt(found.values)
    wide = turn.shape[1]
    padded = lambda m: np.vstack([m, np.zeros((size - m.shape[0], m.shape[1]))])
    centre = row_sums(rows, size, wide, lambda x: padded(((x - mean) @ turn).sum(axis=0)[None, :]))[0] / found.n

    def part(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ turn - centre
        return padded(white.T @ white)

    return float(np.abs(row_sums(rows, size, wide, part)[:wide] / found.n - np.eye(wide)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the entries of (n x - S)^2, exact; None where a long can't hold it."""
    if not len(x):
        return []
    reach = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums), default=0)
    if reach * reach * len(sums) <= LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [d if d <= LONG else None for d in exact]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row, one row for each component.

    Rows whose vector is null or holds null or non-finite entries are dropped. Entries become x = floor(256 c); the fit
    list holds each distinct x once, so copies of a vector, however many, don't weigh. Vectors of different length are
    fitted apart, each length as a table of its own. Components whose eigenvalue is zero, as with one distinct vector,
    have no whitened value and give no rows; so do vectors without entries. Repeated ids and rows keep their rows. A
    deviation beyond a long is null. Empty table: no rows. Other columns of the input are not read.

    The fit list is written once and read by each pass; the rows are read again for the result, so nothing is held.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding").filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("x"))
    distinct = stage(rows.select("x").distinct().withColumn("size", F.size("x")), "vectors")
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect() if r["size"])
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"vec_id {id_type}, {OUT}")
    for k, size in enumerate(sizes):
        found = fit(distinct.filter(F.col("size") == size), size, components)
        if found is not None and found.values.size:
            part = _apply(rows.filter(F.size("x") == size), size, found, f"vec_id {id_type}, {OUT}")
            out = out.unionByName(part) if k else part
    return out


def _apply(rows: DataFrame, size: int, found: Whitening, schema: str) -> DataFrame:
    mean, turn, top = found.mean, found.vectors / np.sqrt(found.values), found.values.size
    explained = found.values / found.trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4096):
            x = matrix(batch.column(1), size)
            rows_ = len(x)
            white = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows_), top))),
                pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), rows_)),
                pa.array(np.full(rows_ * top, found.n)),
                pa.array([d for d in deviations(x, found.n, found.sums) for _ in range(top)], pa.int64()),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, rows_)),
                pa.array(np.full(rows_ * top, found.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)
