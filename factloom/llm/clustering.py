"""Centroid clustering of integer vectors (Lloyd's rounds), exact, by partial-distance search.

A vector's entries become the integers floor(SCALE * x). To find its nearest centroid, squared differences are added up over the
dimensions of the highest variance first, BLOCK at a time; a centroid is abandoned once its sum is strictly above the distance of
the best so far, and those that survive all dimensions are compared by (distance, number). The search begins with the centroid
that is nearest in the first block, so that the bound is tight from the start.

Each round is one pass: a task sends a row per centroid (count and sums), Spark adds these up, and the driver gets as many rows as
there are centroids, whatever the number of vectors. The final assignment is written once (id, cluster, distance).

Defined results: null vectors, vectors of another length and those with null or non-finite entries have no row; rows with equal ids
are vectors of their own; a null id comes last in the order of starts and is carried along; equal starts stay apart, and the larger
number then keeps no vector and stays as it is; fewer vectors than CENTROIDS make as many centroids as there are vectors; an entry
beyond MOST / SCALE is an error (its squared distance would not fit a long), as is an inertia that doesn't fit; other columns of the
input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stash, unstash
from .vectors import finite_rows, lists, scaled

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SALT = "1:"
BLOCK = 8
MOST = 1 << 27  # 64 squared differences of twice this fit a long
_SLAB = 4096
_LAST = "~"  # behind every hexadecimal digit


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, ties to the smaller number. order: the dimensions as they are added up."""
    x, c = vectors[:, order], centroids[:, order]
    head = ((x[:, None, :block] - c[None, :, :block]) ** 2).sum(axis=2)
    first = head.argmin(axis=1)
    number, best = first.copy(), ((x - c[first]) ** 2).sum(axis=1)
    for j in range(len(c)):
        rows = np.flatnonzero((head[:, j] <= best) & (first != j))
        part = head[rows, j]
        for at in range(block, x.shape[1], block):
            part = part + ((x[rows, at : at + block] - c[j, at : at + block]) ** 2).sum(axis=1)
            alive = part <= best[rows]
            rows, part = rows[alive], part[alive]
        won = (part < best[rows]) | (j < number[rows])
        number[rows[won]], best[rows[won]] = j, part[won]
    return number, best


def _slabs(batch: pa.RecordBatch, column: int, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their integer vectors), some at a time."""
    for at in range(0, batch.num_rows, _SLAB):
        rows, matrix = finite_rows(batch.column(column).slice(at, _SLAB), dims)
        yield rows + at, scaled(matrix, scale, MOST)


def _survey(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> DataFrame:
    """Per task: its k first vectors in the order of starts (key, x), and a row with key null: sums and sums of squares. vectors: id, vec, name (the id as text)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, sums, squares, n = [], np.zeros(dims), np.zeros(dims), 0
        for batch in batches:
            for rows, x in _slabs(batch, 1, dims, scale):
                names = batch.column(2).take(pa.array(rows)).to_pylist()
                keys = [_LAST if name is None else hashlib.sha256((salt + name).encode()).hexdigest() for name in names]
                bar = least[-1][0] if len(least) == k else _LAST
                least = heapq.nsmallest(k, least + [(key, row.tolist()) for key, row in zip(keys, x, strict=True) if key <= bar])
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x.astype(np.float64) ** 2).sum(axis=0)
        arrays = [pa.array([key for key, _ in least] + [None], pa.string()), pa.array([x for _, x in least] + [None], pa.list_(pa.int64())), pa.array([None] * len(least) + [n], pa.int64())]
        arrays += [pa.array([None] * len(least) + [v.tolist()], pa.list_(pa.float64())) for v in (sums, squares)]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "x", "n", "sums", "squares"])

    return in_arrow(vectors, look, "key string, x array<long>, n long, sums array<double>, squares array<double>")


def _totals(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int) -> list:
    """A row per centroid that has vectors: cluster, n and t0, t1, ... (sums of its vectors' entries)."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x in _slabs(batch, 1, dims, scale):
                number, _ = nearest(x, centroids, order)
                count += np.bincount(number, minlength=k)
                for j in np.unique(number).tolist():
                    sums[j] += x[number == j].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists(sums[some])], ["cluster", "n", "sums"])

    rows = in_arrow(vectors, add, "cluster int, n long, sums array<long>")
    exact = lambda column: F.sum(column.cast("decimal(38,0)"))
    return rows.groupBy("cluster").agg(exact(F.col("n")).alias("n"), *[exact(F.col("sums")[i]).alias(f"t{i}") for i in range(dims)]).collect()


def fitted_centroids(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> tuple[np.ndarray, np.ndarray]:
    """(centroids after the rounds, the dimensions by falling variance)."""
    rows = _read(vectors, id_col, vector_col)
    seen = stash(_survey(rows, k, dims, scale, salt), "survey")
    starts = seen.where("key is not null").orderBy("key", "x").limit(k).select("x").collect()
    told = seen.where("key is null").agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("sums", "squares") for i in range(dims)]).first()
    unstash(seen)
    centroids = np.array([row["x"] for row in starts], np.int64).reshape(-1, dims)
    if not len(centroids):
        return centroids, np.arange(dims)
    variance = np.array([told[f"squares{i}"] / told["n"] - (told[f"sums{i}"] / told["n"]) ** 2 for i in range(dims)])
    order = np.argsort(-variance, kind="stable")
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _totals(rows, centroids, order, scale):
            moved[row["cluster"]] = [int(row[f"t{i}"]) // int(row["n"]) for i in range(dims)]
        centroids = moved
    return centroids, order


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.col(id_col).cast("string").alias("name"))


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, cluster, distance of each usable vector."""
    rows = _read(vectors, id_col, vector_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _slabs(batch, 1, centroids.shape[1], scale):
                if len(at):
                    number, distance = nearest(x, centroids, order)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return in_arrow(rows, assign, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """One row per usable vector: <id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    centroids, order = fitted_centroids(vectors, id_col, vector_col, k, rounds, dims, scale, salt)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)  # there is no vector, so nothing is assigned to it
    placed = stash(assigned(vectors, centroids, order, id_col, vector_col, scale), "assigned")
    sums = {row["cluster"]: int(row["s"]) for row in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(sums)]
    facts = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(facts), "cluster")  # a row per centroid: k at most
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> str:
    """The rows of clustered() in DuckDB SQL: every vector against every centroid."""
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS cluster, x AS c FROM kept QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, x, cluster, c, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept, c{r})")
        steps.append(f"a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY distance, cluster) = 1)")
        if r < rounds:
            steps.append(f"e{r} AS (SELECT cluster, i, CAST(sum(v) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM e{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS (SELECT o.cluster, coalesce(m.x, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    return f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"
