"""Embedding whitening from an exact integer scatter matrix.

Entries become the integers x = floor(SCALE * c) + SHIFT. Less the shift, tasks add them and their products up exactly: by a float64
matrix product where no sum can reach 2^53, by Python integers otherwise. What a task has gathered leaves it in limbs of LIMB bits
that Spark adds up as longs, so sums have no largest size. The driver gets d (d + 1) / 2 products and d sums (d dimensions), forms
n X'X - SS' in integers, and only then divides to float64 and decomposes by eigh. Vectors are then projected where they are read and
written once (id, deviation, projections); the covariance of what came out is measured on that table.

Defined results: null vectors and those with null or non-finite entries have no row; the space is that of the most frequent length
(of equally frequent ones, the longer), and vectors of another length, empty ones among them, lie outside of it and have no row;
rows with equal ids are vectors of their own, a null id is carried along; a component whose eigenvalue is zero to double precision has
whitened null and is left out of identity_error; without any spread, explained is 0; an entry beyond MOST / SCALE and more than
MOST_DIMS dimensions are errors; a deviation beyond 38 digits is one; other columns of the input are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stash
from .vectors import finite_rows, lists, scaled

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
MOST = 1 << 62
MOST_DIMS = 4096  # the driver decomposes a matrix of this size
LIMB = 40
_SLAB = 4096
_EXACT = 1 << 53


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums, products) of integer vectors, exactly."""
    most = int(np.abs(x).max()) if x.size else 0
    if most * most * max(1, len(x)) < _EXACT:
        f = x.astype(np.float64)
        return x.sum(axis=0).tolist(), (f.T @ f).astype(np.int64).tolist()
    big = x.astype(object)
    return [int(v) for v in big.sum(axis=0)], (big.T @ big).tolist()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) of the limbs that are not zero; value is the sum of limb << LIMB * number."""
    sign, rest, k = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if limb := rest & ((1 << LIMB) - 1):
            yield k, sign * limb
        rest, k = rest >> LIMB, k + 1


def _usual_length(rows: DataFrame) -> int:
    """The most frequent length of the usable vectors; 0 without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            lengths = [d for d in pc.unique(pc.list_value_length(vec)).to_pylist() if d]
            counts = [len(finite_rows(vec, d)[0]) for d in lengths]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], ["d", "n"])

    found = in_arrow(rows, count, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def exact_moments(rows: DataFrame, dims: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, products) of the integers floor(scale * c) of all usable vectors. rows: id, vec."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLAB):
                _, matrix = finite_rows(batch.column(1).slice(at, _SLAB), dims)
                s, p = scatter(scaled(matrix, scale, MOST))
                n, sums, products = n + len(matrix), sums + np.array(s, object), products + np.array(p, object)
        told = [(-1, -1, 0, n)]  # the count is a value without a place
        told += [(i, -1, k, v) for i in range(dims) for k, v in _limbs(int(sums[i]))]
        told += [(i, j, k, v) for i in range(dims) for j in range(i, dims) for k, v in _limbs(int(products[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "limb", "v"])

    n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for i, j, k, v in in_arrow(rows, gather, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        value = int(v) << (LIMB * k)
        if i < 0:
            n += value
        elif j < 0:
            sums[i] += value
        else:
            products[i][j] += value
            products[j][i] = products[i][j]
    return n, sums, products


def components_of(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvectors as columns, eigenvalues, explained shares) of the covariance, by falling eigenvalue; eigenvalues that are zero to double precision are 0."""
    dims = len(sums)
    covariance = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most].copy(), vectors[:, ::-1][:, :most]
    values[values <= dims * np.finfo(float).eps * max(values[0], 0.0)] = 0.0
    trace = sum(n * products[i][i] - sums[i] * sums[i] for i in range(dims)) / (n * n)
    return vectors, values, values / trace if trace else np.zeros(len(values))


def _squares(y: np.ndarray) -> pa.Array:
    """The sum of each row's squares, exactly, as decimals."""
    most = int(max(abs(int(y.max())), abs(int(y.min())))) if y.size else 0
    if y.dtype != object and most * most * y.shape[1] < 1 << 63:
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum(int(v) * int(v) for v in row)) for row in y], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row per usable vector and component: <id_col>, component, n, deviation decimal(38,0), whitened, explained, identity_error.

    x = floor(scale * c) + shift. The shift is taken off again before anything is added up, and n x - S doesn't depend on it, so it changes no result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    dims = _usual_length(rows)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors have {dims} dimensions; the most is {MOST_DIMS}")
    if not dims:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
    n, sums, products = exact_moments(rows, dims, scale)
    axes, values, shares = components_of(n, sums, products, min(components, dims))
    some = values > 0
    factors = axes[:, some] / np.sqrt(values[some])
    fits = n < 1 << 62 and all(abs(s) < 1 << 61 for s in sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLAB):
                own, matrix = finite_rows(batch.column(1).slice(at, _SLAB), dims)
                if not len(own):
                    continue
                x = scaled(matrix, scale, MOST)
                small = fits and int(np.abs(x).max()) * n < 1 << 61
                y = x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
                w = (y / n).astype(np.float64) @ factors
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + at)), _squares(y), lists(w)], ["id", "deviation", "w"])

    made = stash(in_arrow(rows, project, f"id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    error = identity_error(made, int(some.sum()), n)
    out = made.select("id", "deviation", F.posexplode(F.concat("w", F.array_repeat(F.lit(None).cast("double"), int((~some).sum())))).alias("k", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("k") + 1)
    return out.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(made: DataFrame, size: int, n: int) -> float:
    """The largest entry of |covariance of w - identity|, centred before multiplying. made: w, arrays of this size."""
    if not size:
        return 0.0
    means = made.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(size)]).first()
    centred = [F.col("w")[i] - F.lit(means[f"m{i}"]) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = made.agg(*[F.sum(centred[i] * centred[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"s{i}_{j}"] / n - (i == j)) for i, j in pairs)
