"""Most similar vectors against brute force."""

import datetime as dt

import numpy as np
import pytest

from corpusflow.llm.similar import SPACE, count_collisions, most_similar, similar_pairs, similar_vectors, unit_vectors

SCHEMA = "id string, store_name string, namespace string, embedding array<float>, created_at timestamp, neighbour int"
T = dt.datetime(2025, 1, 1)


def clustered(n, dim=32, seed=1, clusters=None, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters or n // 8, dim))
    rows = centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, dim))
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def brute(rows, k, floor=-1.0):
    s = rows @ rows.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {(i, int(j)) for i in range(len(rows)) for j in top[i] if s[i, j] >= floor}


def test_count_collisions_recall():
    rows = clustered(1200)
    q, o, s = count_collisions(rows, 5, (0.632, 1.05, 1.45), 96, 0.6, -1.0)
    found, wanted = set(zip(q.tolist(), o.tolist())), brute(rows, 5)
    assert len(found & wanted) / len(wanted) >= 0.95
    assert np.allclose(s, (rows[q] * rows[o]).sum(1), atol=1e-5)


def test_block_of_one_and_copies():
    assert [len(x) for x in count_collisions(clustered(1, clusters=1), 5, (0.6,), 32, 0.6, -1.0)] == [0, 0, 0]
    q, o, _ = count_collisions(np.repeat(clustered(1, clusters=1), 4, axis=0), 2, (0.6,), 32, 0.6, 0.8)
    assert sorted(zip(q.tolist(), o.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]


def test_cut_namespace_keeps_recall(spark):
    rows = clustered(1500, noise=0.2)
    frame = spark.createDataFrame([(f"{i:05d}", "s", "n", r.tolist(), T, 0) for i, r in enumerate(rows)], SCHEMA)
    units = unit_vectors(frame, 32)
    found = {(int(a), int(b)) for a, b, _ in similar_vectors(units, 3, 0.8, (0.632,), block_rows=200, route_similarity=0.8, route_recall=0.98, dim=32).collect()}
    wanted = brute(rows, 3, 0.8)
    assert len(found & wanted) / len(wanted) >= 0.9


def test_mass_of_near_copies_is_split(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    rows = base + 1e-4 * rng.standard_normal((600, 32))
    frame = spark.createDataFrame([(f"{i:05d}", "s", "n", r.tolist(), T, 0) for i, r in enumerate(rows)], SCHEMA)
    found = similar_vectors(unit_vectors(frame, 32), 2, 0.8, (0.632,), block_rows=50, dim=32).groupBy("id").count().collect()
    assert len(found) == 600 and all(r["count"] == 2 for r in found)


@pytest.mark.parametrize("noise", [0.002, 0.08])
def test_third_in_one_dense_cluster_keeps_recall(spark, noise):
    rng = np.random.default_rng(5)
    mass = rng.standard_normal(32) / 32**0.5 + noise * rng.standard_normal((500, 32))
    rows = np.concatenate([mass / np.linalg.norm(mass, axis=1, keepdims=True), clustered(1000, noise=0.2)]).astype(np.float32)
    frame = spark.createDataFrame([(f"{i:05d}", "s", "n", r.tolist(), T, 0) for i, r in enumerate(rows)], SCHEMA)
    found = {(int(a), int(b)) for a, b, _ in similar_vectors(unit_vectors(frame, 32), 5, 0.8, (0.632,), block_rows=50, route_similarity=0.8, route_recall=0.98, dim=32).collect()}
    wanted = {(a, b) for a, b in brute(rows.astype(np.float64), 5, 0.8) if a < 500}
    assert len(found & wanted) / len(wanted) >= 0.95


def test_unusable_versions_copies_and_namespaces(spark):
    v, w = [1.0] * 8, [1.0] * 7 + [0.9]
    nan, none = [float("nan")] + [1.0] * 7, [None] + [1.0] * 7
    data = [
        ("a", "s", "n", v, T, 1), ("a", "s", "n", v, T, 1), ("b", "s", "n", w, T, 1), ("c", "s", "n", [2.0] * 8, T, 1),  # c is a copy of a
        ("old", "s", "n", v, T, 1), ("old", "s", "n", nan, T + dt.timedelta(1), 1), ("null", "s", None, v, T, 1), ("zero", "s", "n", [0.0] * 8, T, 1),
        ("hole", "s", "n", none, T, 1), ("short", "s", "n", [1.0] * 7, T, 1), ("miss", "s", "n", None, T, 1), ("far", "s", "m", v, T, 1), (None, "s", "n", v, T, 1), ("other", "t", "n", v, None, 1),
    ]
    frame = spark.createDataFrame(data, SCHEMA)
    assert {tuple(r) for r in similar_pairs(frame, dim=8).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    best = {(r["id"], r["neighbour"], r["rank"]) for r in most_similar(frame, 1, dim=8).collect()}
    assert best == {("a", "c", 1), ("c", "a", 1), ("b", "a", 1)}


def test_large_group_of_copies_is_complete_but_not_squared(spark):
    frame = spark.createDataFrame([(f"{i:03d}", "s", "n", [1.0] * 8, T, 0) for i in range(60)], SCHEMA)
    near = most_similar(frame, 5, 0.8, 8).groupBy("id").count().collect()
    assert len(near) == 60 and all(r["count"] == 5 for r in near)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert similar_pairs(frame, dim=8).count() == 0
    assert set(SPACE) <= set(unit_vectors(frame, 8).columns)
