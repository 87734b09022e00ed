"""Clustering with bounds against plain rounds of full scans; bounds never decide otherwise than integers."""

import hashlib

import numpy as np
import pytest

from lectern.llm import hamerly, queries, shared


def direct(rows, ids, k, rounds, seed="2:"):
    order = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), tuple(v)) for i, v in zip(ids, rows.tolist(), strict=True) if i is not None)
    centroids = np.array([v for _, v in order[:k]], object)
    rows = rows.astype(object)
    near = lambda: np.array([((rows - c) ** 2).sum(axis=1) for c in centroids]).T
    for _ in range(rounds):
        cluster = near().argmin(axis=1)
        for c in range(len(centroids)):
            if (cluster == c).any():
                centroids[c] = rows[cluster == c].sum(axis=0) // int((cluster == c).sum())
    squared = near()
    cluster = squared.argmin(axis=1)
    return cluster, squared[np.arange(len(rows)), cluster], centroids


def test_query_equals_plain_rounds(spark, data):
    got = {r.vec_id: r for r in queries.op11_hamerly(spark, data).collect()}
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    rows = np.array([np.floor(np.asarray(v, np.float64) * 256) for v in table.embedding]).astype(np.int64)
    cluster, distance, centroids = direct(rows, table.vec_id.tolist(), 40, 5)
    assert len(got) == len(table)
    for i, c, d in zip(table.vec_id.tolist(), cluster.tolist(), distance.tolist(), strict=True):
        r = got[i]
        assert (r.cluster, r.distance) == (c, d)
        assert r.cluster_inertia == distance[cluster == c].sum() and r.inertia == distance.sum()
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


@pytest.mark.parametrize("scale, spread", [(4, 3.0), (1, 40_000_000.0)])
def test_ties_copies_wide_values_and_rows_that_do_not_count(spark, monkeypatch, scale, spread):
    rng = np.random.default_rng(int(scale))
    rows = np.clip(np.round(rng.normal(size=(300, 3)) * spread, 2), -1.3e8, 1.3e8)
    rows[100:200] = rows[0]  # a third are copies
    rows[200:230] = -rows[:30]
    ids = [*range(250), *[7] * 20, *[None] * 30]
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0]), (905, [1e30, 0.0, 0.0]), (906, [])]
    table = spark.createDataFrame([*zip(ids, rows.tolist(), strict=True), *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS block", "2 AS size", "3 AS moved")
    near, centroids = hamerly.clustered(table.repartition(3), shared.workspace(spark, "t"), k=12, rounds=4, scale=scale, dimension=3)
    whole = np.floor(rows * scale).astype(np.int64)
    cluster, distance, want = direct(whole, ids, 12, 4)
    assert (centroids == want.astype(np.int64)).all()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in near.collect()), key=key) == sorted(zip(ids, cluster.tolist(), [int(d) for d in distance], strict=True), key=key)
    assert hamerly.with_inertia(near, centroids).count() == 300


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [5.0, 5.0])], "vec_id long, embedding array<double>")
    near, centroids = hamerly.clustered(few, shared.workspace(spark, "t"), k=40, dimension=2)
    assert len(centroids) == 2 and sorted(r.cluster for r in near.collect())[0] == 0 and near.count() == 3
    for empty in (few.limit(0), few.where("vec_id is null")):
        near, centroids = hamerly.clustered(empty, shared.workspace(spark, "t"), dimension=2)
        assert hamerly.with_inertia(near, centroids).collect() == [] and not len(centroids)


def test_bounds_leave_vectors_unread_and_change_nothing():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(-20, 20, size=(400, 5)) + 400 * np.eye(5, dtype=np.int64)[c] for c in range(5)])
    centroids = rows[::400].copy()
    cluster, best, second = hamerly.scanned(rows, centroids)
    upper, lower = hamerly.above(best), hamerly.below(second)
    asked = []
    for _ in range(4):
        moved = centroids + rng.integers(-3, 4, size=centroids.shape)
        drift = hamerly.above(((moved - centroids) ** 2).sum(axis=1))
        centroids = moved

        def take(places):
            asked.append(len(places))
            return rows[places]

        cluster, upper, lower, _ = hamerly.reassigned(take, centroids, drift, cluster, upper, lower)
        exact = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper >= np.sqrt(exact.min(axis=1))).all() and (lower <= np.sqrt(np.sort(exact, axis=1)[:, 1])).all()
    assert sum(asked) < len(rows) / 4
