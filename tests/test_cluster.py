from __future__ import annotations

import numpy as np
import pytest

from latticework.operators import cluster


def numpy_lloyd(x, c, steps):
    c = np.round(c, 9)
    for _ in range(steps):
        near = np.round(((x[:, None] - c[None]) ** 2).sum(2), 9).argmin(1)
        new = np.array([np.round(x[near == j].mean(0), 9) if (near == j).any() else c[j] for j in range(len(c))])
        if np.array_equal(new, c):
            break
        c = new
    d = np.round(((x[:, None] - c[None]) ** 2).sum(2), 9)
    return c, np.bincount(d.argmin(1), minlength=len(c)), d.min(1).sum()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.4, (40, 3)) for m in ([0, 0, 0], [3, 1, 0], [1, 4, 2])]).round(3)
    rows = [(k, *map(float, v)) for k, v in enumerate(x)] + [(1000, None, 1.0, 1.0)]
    return x, spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)


def test_steps_equal_numpy(points):
    x, df = points
    sets = [x[:2], x[[5, 60, 100]], np.vstack([x[:3], [[99.0, 99, 99]]])]  # the last centre never has rows
    for steps in (1, 3, 50):
        for (c, n, d), start in zip(cluster.lloyd(df, ["a", "b", "c"], sets, steps), sets, strict=True):
            want = numpy_lloyd(x, start, steps)
            assert np.allclose(c, want[0], atol=1e-8) and n.tolist() == want[1].tolist() and d == pytest.approx(want[2])


def test_best_of_hashed_starts_finds_the_groups(points):
    x, df = points
    starts = cluster.hashed_starts(df, ["a", "b", "c"], 3, 4)
    by_hash = [sorted(range(len(x)), key=lambda i: ((i * 48271 + 11 + 7919 * s) % 2147483647, i))[:3] for s in range(4)]  # noqa: B023
    assert all(np.allclose(c, x[i]) for c, i in zip(starts, by_hash, strict=True))
    labels = {r.id: r.cluster for r in cluster.kmeans(df.dropna(), ["a", "b", "c"], 3, 4).collect()}
    groups = [{labels[i] for i in range(k, k + 40)} for k in (0, 40, 80)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    best = min((numpy_lloyd(x, c, 100)[2] for c in starts))
    assert sum(((x[i] - x[[j for j in labels if labels[j] == labels[i]]].mean(0)) ** 2).sum() for i in range(len(x))) == pytest.approx(best, abs=1e-4)


def test_equal_distances_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 1.0)], "id long, a double")
    ((c, n, d),) = cluster.lloyd(df, ["a"], [np.array([[0.0], [2.0]])], 1)
    assert n.tolist() == [2, 1] and c.ravel().tolist() == [0.5, 2.0] and d == pytest.approx(0.5)
    assert {r.id: r.j for r in df.select("id", cluster.nearest_centre(["a"], np.array([[0.0], [2.0]])).alias("j")).collect()} == {1: 0, 2: 1, 3: 0}


def test_names_when_one_cluster_is_both(spark):
    """The cluster of most vitality has the least stress, too: calm is the least stressed of the others."""
    rows = [(0, 1.0, 9.0), (1, 2.0, 5.0), (2, 3.0, 1.0)]
    df = spark.createDataFrame([(3 * i + k, c, s, v) for i, (c, s, v) in enumerate(rows) for k in range(3)], "id long, cluster int, s double, v double")
    named = {r.cluster: r.archetype for r in cluster.name_archetypes(df, "s", "v").select("cluster", "archetype").distinct().collect()}
    assert named == {0: "vital", 1: "calm", 2: "balanced"}


def test_squares_of_wide_rows_keep_digits_where_rows_are_near():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(60, 64))
    b = np.concatenate([a[:20], a[:20] + 1e-7, rng.normal(size=(40, 64)), np.full((1, 64), 1e6)])
    for x, y in ((a, b), (a + 1e5, b + 1e5), (a[:, :2], b[:, :2])):
        want = ((x[:, None] - y[None]) ** 2).sum(2)
        assert np.allclose(cluster._squared(x, y), want, rtol=1e-11, atol=0)
