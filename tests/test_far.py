from __future__ import annotations

import numpy as np

from latticework.operators import cluster, far


def brute(x, l):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    names, n = np.unique(l, return_counts=True)
    s = np.column_stack([d[:, l == k].sum(1) for k in names])
    own = l[:, None] == names
    a = s[own] / np.maximum(n[np.searchsorted(names, l)] - 1, 1)
    b = np.where(own, np.inf, s / n).min(1)
    return np.where(n[np.searchsorted(names, l)] > 1, (b - a) / np.maximum(a, b), 0)


def test_blocks_give_all_pairs_silhouettes(spark, monkeypatch):
    """Rows in a plane meet by blocks: a task sees few of a block's pairs, and each silhouette is that of all pairs."""
    monkeypatch.setattr(cluster, "FEW", 100)
    monkeypatch.setattr(far, "ROWS", 20)
    monkeypatch.setattr(far, "PARTITION", 700)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (1500, 2)), rng.normal(5, 0.01, (700, 2)), np.full((100, 2), 7.5), [[900.0, -40.0]], np.column_stack([np.full(500, 3.0), rng.normal(size=500)])])
    label = np.r_[rng.integers(0, 3, len(x) - 1), 9]  # 9 is a label of one row
    df = spark.createDataFrame([(i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(x, label, strict=True))], "id long, a double, b double, l int")
    monkeypatch.setattr(cluster, "meetings", None)
    got = {r.id: r.silhouette for r in cluster.silhouette(df, ["a", "b"], "l").collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], brute(x, label), atol=1e-9)
    line = {r.id: r.silhouette for r in cluster.silhouette(df, ["b"], "l").collect()}
    assert np.allclose([line[i] for i in range(len(x))], brute(x[:, 1:], label), atol=1e-9)


def test_few_pairs_meet(monkeypatch):
    rng = np.random.default_rng(4)
    x, met = rng.uniform(size=(16_384, 2)), []
    x = x[np.argsort(far.curve(x, x.min(0), x.max(0)))].reshape(-1, 64, 2)
    lo, hi = x.min(1), x.max(1)
    t = far.tree(lo, hi, np.array([far.shares(p, a, b).sum(0) for p, a, b in zip(x, lo, hi, strict=True)]), np.zeros(len(x), int))
    for k in range(0, len(x), 16):
        near = t.met(lo[k], hi[k])[1]
        met.append(len(near))
        got = far.sums(t, x[k], {int(i): (x[i], np.ones(64)) for i in near}, 1)[:, 0]
        assert np.allclose(got, [np.sqrt(((x.reshape(-1, 2) - p) ** 2).sum(1)).sum() for p in x[k]], rtol=1e-10)
    assert np.mean(met) < 0.2 * len(x)


def test_rows_without_a_number_take_the_way_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FEW", 2)
    monkeypatch.setattr(far, "silhouettes", None)
    df = spark.createDataFrame([(k, float(k), None if k == 3 else 1.0, k % 2) for k in range(6)], "id long, a double, b double, l int")
    assert cluster.silhouette(df, ["a", "b"], "l").count() == 6


def test_scores_of_k_means_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FEW", 100)
    monkeypatch.setattr(cluster, "meetings", None)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(400, 2)), 2, axis=0)  # equal rows count as often as they are there
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double")
    got = {r.k: r.silhouette for r in cluster.scores(df, ["a", "b"], [2, 3], starts=2, steps=4).collect()}
    for k in (2, 3):
        l = {r.id: r.cluster for r in cluster.kmeans(df, ["a", "b"], k, 2, 4).collect()}
        assert np.isclose(got[k], brute(x, np.array([l[i] for i in range(len(x))])).mean(), atol=1e-10)


def test_vote_by_blocks_equals_sql(spark, sf, monkeypatch):
    import duckdb

    from latticework.plans import QUERIES, SQL

    monkeypatch.setattr(cluster, "FEW", 50)
    monkeypatch.setattr(cluster, "meetings", None)
    d = duckdb.connect()
    d.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{sf}/customer.parquet')")
    assert [tuple(r) for r in QUERIES["majority_vote_k"](spark, sf).collect()] == d.sql(SQL["majority_vote_k"]).fetchall()
