from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import cluster, graph, meet


def groups(rng, many=20, each=30, dims=16, spread=0.05):
    centres = rng.normal(size=(many, dims))
    return np.concatenate([c + spread * rng.normal(size=(each, dims)) for c in centres])


def brute(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    np.fill_diagonal(sim, -np.inf)
    return {i: sorted(range(len(v)), key=lambda j: (-sim[i, j], j))[: min(k, len(v) - 1)] for i in range(len(v))}  # noqa: B023


def found(df):
    out = {}
    for r in df.orderBy("src", "pos").collect():
        out.setdefault(r.src, []).append(r.dst)
    return out


def test_neighbours_equal_brute_force_and_few_cells_are_visited(spark):
    rng = np.random.default_rng(1)
    v = groups(rng)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    assert found(graph.cosine_nearest(df, 8)) == brute(v, 8)
    pivots = graph._pivots(df, None)
    placed = graph._placed(df, pivots)
    least = spark.createDataFrame([(i, float((lambda u: np.sort(u @ u[i])[-9])(v / np.linalg.norm(v, axis=1, keepdims=True)))) for i in range(len(v))], "id long, least double")
    pairs = graph.visits(placed, least, pivots).groupBy("home").agg(F.count("*").alias("n")).collect()
    n = {r.home: r.n for r in pairs}
    assert n[True] == len(v) and n[True] + n[False] < 0.25 * len(v) * len(pivots)  # of all rows with all cells


def test_copies_in_one_cell_zero_vectors_and_few_rows(spark, monkeypatch):
    """More equal rows than a block holds, met in several blocks."""
    monkeypatch.setattr(meet, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    v = np.concatenate([np.tile(rng.normal(size=4), (60, 1)), rng.normal(size=(30, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    assert found(graph.cosine_nearest(df, 5)) == brute(v, 5)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    assert found(graph.cosine_nearest(few, 8)) == {1: [3, 2], 2: [1, 3], 3: [1, 2]}
    assert graph.cosine_nearest(few.limit(0), 8).collect() == []
    assert graph.cosine_nearest(few.limit(1), 8).collect() == []


def test_rows_without_structure_are_sent_to_heaps_not_to_cells(spark, monkeypatch):
    monkeypatch.setattr(meet, "BLOCK_ROWS", 25)
    v = np.random.default_rng(7).normal(size=(400, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    sent, real = [], graph.visits

    def counted(*args):
        out = real(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(graph, "visits", counted)
    assert found(graph.cosine_nearest(df, 8)) == brute(v, 8)
    assert 400 < sum(sent) <= 400 * 5  # four hundred rows are four or five heaps of a hundred; there are twenty cells


def silhouettes(x, l):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = l == l[i]
        others = [d[i, l == k].mean() for k in np.unique(l) if k != l[i]]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        out.append((min(others) - a) / max(a, min(others)) if own.sum() > 1 and others else 0.0)
    return np.array(out)


def test_silhouette_meets_few_clusters(spark, monkeypatch):
    monkeypatch.setattr(meet, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = groups(rng, 12, 25, 3, 0.4)
    label = np.repeat(np.arange(12), 25)
    label[:60] = 0  # a cluster of several groups
    df = spark.createDataFrame([(i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(x, label, strict=True))], "id long, a double, b double, c double, l int")
    got = {r.id: r.silhouette for r in cluster.silhouette(df, ["a", "b", "c"], "l").collect()}
    assert np.allclose([got[i] for i in range(len(x))], silhouettes(x, label), atol=1e-9)
    opened = cluster.open_labels(df, ["a", "b", "c"], "l").count()
    assert len(x) * 2 <= opened < len(x) * len(set(label.tolist())) / 2


def test_silhouette_of_one_cluster_of_single_rows_and_of_equal_rows(spark):
    one = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0)], "id long, a double, l int")
    assert {r.silhouette for r in cluster.silhouette(one, ["a"], "l").collect()} == {0.0}
    single = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1)], "id long, a double, l int")
    assert {r.silhouette for r in cluster.silhouette(single, ["a"], "l").collect()} == {0.0}
    same = spark.createDataFrame([(k, 5.0, k % 2) for k in range(6)], "id long, a double, l int")
    assert {r.silhouette for r in cluster.silhouette(same, ["a"], "l").collect()} == {0.0}


def test_equal_rows_of_a_cluster_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 2)), 10, axis=0)
    label = np.repeat(np.arange(12) % 3, 10)
    met, real = [], cluster.meetings

    def counted(rows, members, *rest):
        met.append(members.count())
        return real(rows, members, *rest)

    monkeypatch.setattr(cluster, "meetings", counted)
    df = spark.createDataFrame([(i, *map(float, p), int(l)) for i, (p, l) in enumerate(zip(x, label, strict=True))], "id long, a double, b double, l int")
    got = {r.id: r.silhouette for r in cluster.silhouette(df, ["a", "b"], "l").collect()}
    assert met == [12] and np.allclose([got[i] for i in range(len(x))], silhouettes(x, label), atol=1e-9)


def test_blocks_of_a_hot_key_are_small(spark):
    """Half of all rows have one key; no pair of blocks gets much more than its share."""
    import pyarrow as pa

    rows = spark.range(2000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).cast("int").alias("key"), "id")
    size = meet.meetings(rows, rows, lambda q, m: pa.table({"n": [q.num_rows], "m": [m.num_rows]}), "n long, m long", rows=100)
    got = size.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum(F.col("n") * F.col("m")).alias("pairs")).first()
    assert got.n < 160 and got.m < 160 and got.pairs == 1000 * 1000 + 1000
