import hashlib
import math

import duckdb
import numpy as np
import pytest

from factloom.llm.clustering import assigned, clustered, clusters_sql, fitted_centroids, nearest
from factloom.llm.whitening import components_of, scatter, whitened

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    """Vectors with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, v, 3, 4, "k", 5, 0.5, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, n long, key string, component int, w double, id int")


def vectors(seed, n, dims=64, kind=np.float32, spread=1.0):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(6, dims)) * spread
    return (middles[rnd.integers(0, 6, n)] + rnd.normal(size=(n, dims)) * 0.3).astype(kind).tolist()


def unusable(dims=64):
    return [(901, None), (902, []), (903, [1.0] * (dims - 1)), (904, [None] + [1.0] * (dims - 1)), (905, [NAN] + [1.0] * (dims - 1)), (906, [INF] * dims), (907, [1.0] * (dims + 1))]


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]  # noqa: E731, B905
    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]
            if own:
                centroids[j] = [sum(e) // len(own) for e in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)))


def told(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_clusters_equal_brute_force(spark):
    rows = list(enumerate(vectors(1, 300))) + unusable()
    df = table(spark, rows)
    assert told(clustered(df.repartition(5))) == brute_clusters(rows)
    assert clustered(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_repeated_rows_null_ids_and_few_vectors(spark):
    few = [[float(k % 3)] * 64 for k in range(9)]
    rows = list(enumerate(few)) + [(3, few[3]), (3, few[4]), (None, few[5]), (None, [-0.001] * 64)]
    assert told(clustered(table(spark, rows, "double"))) == brute_clusters(rows)
    assert clustered(table(spark, [])).count() == 0
    assert clustered(table(spark, unusable())).count() == 0
    assert told(clustered(table(spark, [(None, few[1])]))) == brute_clusters([(None, few[1])])


def test_search_equals_all_distances_with_ties():
    rnd = np.random.default_rng(5)
    x, c = rnd.integers(-3, 4, (500, 64)), rnd.integers(-3, 4, (16, 64))
    c[9] = c[4]
    x[:40] = (c[1] + c[2]) // 2
    all_of = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    number, distance = nearest(x, c, np.argsort(-x.var(axis=0)))
    assert np.array_equal(number, all_of.argmin(axis=1)) and np.array_equal(distance, all_of.min(axis=1))


def test_entries_too_large_for_a_long_are_errors(spark):
    with pytest.raises(Exception, match="is beyond"):
        clustered(table(spark, [(1, [1e30] * 64)], "double")).collect()


def test_centroids_place_new_vectors(spark):
    rows = list(enumerate(vectors(2, 120)))
    centroids, order = fitted_centroids(table(spark, rows), k=5, rounds=2)
    assert len(centroids) == 5
    assert assigned(table(spark, rows[:7]), centroids, order).count() == 7


def test_cluster_sql_gives_the_same_rows(spark):
    rows = list(enumerate(vectors(3, 200))) + unusable()
    own = duckdb.connect()
    own.execute("create table embeddings(vec_id bigint, embedding float[])")
    own.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(own.execute(clusters_sql()).fetchall()) == told(clustered(table(spark, rows)))


def brute_whitening(rows, most=8):
    kept = [(i, [math.floor(1024 * float(e)) + 100000 for e in v]) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    n = len(kept)
    x = np.array([v for _, v in kept], object)
    s = x.sum(axis=0)
    y = n * x - s
    v = (y.T @ y / n**3).astype(float)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    w = (y / n).astype(float) @ axes / np.sqrt(values)
    return {i: int((row * row).sum()) for (i, _), row in zip(kept, y, strict=True)}, {(i, k + 1): w[r, k] for r, (i, _) in enumerate(kept) for k in range(w.shape[1])}, values / np.trace(v)


@pytest.mark.parametrize("dims", [5, 64])
def test_whitening_equals_brute_force(spark, dims):
    rows = list(enumerate(vectors(4, 250, dims)))
    found = whitened(table(spark, rows + [(i, v) for i, v in unusable(dims) if v is None or None in v or NAN in v or INF in v]).repartition(4)).collect()
    deviations, w, shares = brute_whitening(rows)
    assert len(found) == 250 * min(8, dims)
    signs = {k: np.sign(next(r.whitened for r in found if r.component == k and r.vec_id == 0) * w[0, k]) for k in range(1, min(8, dims) + 1)}
    for r in found:
        assert r.n == 250 and r.deviation == deviations[r.vec_id]
        assert r.whitened == pytest.approx(signs[r.component] * w[r.vec_id, r.component], abs=1e-9)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert r.identity_error == found[0].identity_error <= 1e-9


def test_whitening_without_spread_of_other_lengths_and_of_nothing(spark):
    same = whitened(table(spark, [(1, [1.0, 2.0])] * 3 + [(2, [])])).collect()
    assert [(r.vec_id, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(1, 3, 0, None, 0.0, 0.0)] * 6
    line = whitened(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (None, [5.0, 6.0]), (4, [1.0, 2.0, 3.0])])).collect()
    assert sorted((r.vec_id or -1, r.component, r.n) for r in line) == [(-1, 1, 3), (-1, 2, 3), (1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3)]
    assert all((r.whitened is None) == (r.component == 2) and r.explained == pytest.approx(2 - r.component) for r in line)
    assert whitened(table(spark, [])).collect() == [] and whitened(table(spark, [(1, None), (2, [])])).collect() == []


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(k, [1e12 + k, -3e11 * k, 7.0 * k * k]) for k in range(20)]
    found = whitened(table(spark, rows, "double")).collect()
    deviations, _, shares = brute_whitening(rows)
    assert all(int(r.deviation) == deviations[r.vec_id] for r in found)
    assert found[0].explained == pytest.approx(shares[found[0].component - 1], rel=1e-4)


def test_scatter_and_covariance_are_exact():
    rnd = np.random.default_rng(6)
    small, large = rnd.integers(-500, 500, (50, 4)), rnd.integers(-(2**60), 2**60, (50, 4))
    for x in (small, large):
        whole = x.astype(object)
        assert scatter(x) == (whole.sum(axis=0).tolist(), (whole.T @ whole).tolist())
    axes, values, shares = components_of(50, *scatter(small), 4)
    assert np.allclose(axes @ np.diag(values) @ axes.T, np.cov(small.T.astype(float), bias=True)) and shares.sum() == pytest.approx(1)
