from __future__ import annotations

import hashlib
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import expr as E
from latticework.operators import clean, cluster, gat, graph, policy, rank, raster, spatial, stats, weights

from . import plain


def one(df):
    return tuple(df.first())


def test_zero_filter_keeps_missing(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, float("nan"), 2.0), (4, None, 0.0)], "id int, a double, b double")
    assert {r.id for r in clean.drop_zero_rows(df, ["a", "b"]).collect()} == {2, 3}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        clean.require_columns(spark.range(1), ["id", "c", "b"])


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (10.0, None)], "a double, b double")
    assert [r.a for r in clean.impute_median(df, ["a"]).collect()] == [1.0, 3.0, 3.0, 10.0]
    assert {r.b for r in clean.minmax(clean.impute_mean(df, ["b"]), ["b"]).collect()} == {0.0}
    assert {r.b for r in clean.zscore(clean.impute_mean(df, ["b"]), ["b"]).collect()} == {0.0}


def test_finite_and_detour(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(E.finite(F.col("a"))).collect()] == [None, None, 1.0, None]
    d = spark.createDataFrame([(3.0, 1.0), (3.1, 1.0), (0.0, 0.0), (2.0, 0.0)], "net double, euc double")
    assert [r[0] for r in d.select(E.capped_detour(F.col("net"), F.col("euc"))).collect()] == [3.0, 1.0, 0.0, 0.0]


def test_contract_year(spark):
    df = spark.createDataFrame([("0715",), ("07/15",), ("7/2015",), ("x",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(E.contract_year(F.col("c"))).collect()] == [2015, 2015, 2015, None, None, None]


def test_combined_weights_floor_then_normalise(spark):
    e = spark.createDataFrame([("a", 0.001), ("b", 0.5), ("c", 0.499)], "indicator string, weight double")
    c = spark.createDataFrame([("a", 0.001), ("b", 0.4), ("c", 0.599)], "indicator string, weight double")
    got = {r.indicator: r.combined_w for r in weights.combined_weights(e, c).collect()}
    g = np.array([0.001, math.sqrt(0.2), math.sqrt(0.499 * 0.599)])
    w = np.maximum(g / g.sum(), 0.05)
    assert np.allclose([got[k] for k in "abc"], w / w.sum()) and got["a"] < 0.05


def test_topsis_without_spread_is_a_half(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.3)], "id int, a double")
    w = spark.createDataFrame([("a", 1.0)], "indicator string, combined_w double")
    assert [r.score for r in weights.topsis(df, ["a"], w).collect()] == [0.5, 0.5]
    two = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id int, a double")
    assert {r.id: r.score for r in weights.topsis(two, ["a"], w, cost=("a",)).collect()} == {1: 1.0, 2: 0.0}


def test_correlation_p_against_known_values():
    assert abs(stats.correlation_p(0.5, 12) - 0.0978) < 2e-4
    assert abs(stats.correlation_p(0.9, 10) - 0.000387) < 5e-6
    assert stats.correlation_p(0.0, 30) == pytest.approx(1.0)


def test_vif_equals_inverse(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert np.allclose([r.vif for r in stats.vif(df, ["a", "b", "c"]).collect()], want)


def test_nearest_breaks_ties_by_id_and_finds_far_points(spark):
    pts = [(k, float(k % 5) * 100, float(k // 5) * 100) for k in range(25)] + [(90, 9000.0, 9000.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got: dict = {}
    for r in spatial.nearest(df, 3, 150.0).orderBy("src", "pos").collect():
        got.setdefault(r.src, []).append(r.dst)
    for i, x, y in pts:
        want = sorted((math.hypot(x - a, y - b), j) for j, a, b in pts if j != i)[:3]
        assert got[i] == [j for _, j in want]
    assert spatial.nearest(df.limit(0), 3, 100.0).count() == 0


def test_radius_boundary_is_inside(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 600.0, 0.0), (3, 600.1, 0.0)], "id long, x double, y double")
    assert {(r.src, r.dst) for r in spatial.radius_edges(df, 600.0).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_polygon_contiguity(spark):
    sq = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    df = spark.createDataFrame([(1, sq(0.0)), (2, sq(1.0)), (3, sq(5.0))], "id long, ring array<struct<x:double,y:double>>")
    assert {tuple(r) for r in spatial.polygon_contiguity(df).collect()} == {(1, 2), (2, 1)}


def test_merge_takes_the_larger_direction(spark):
    e = spark.createDataFrame([(1, 2, 0.2), (2, 1, 0.7), (2, 3, 0.1), (3, 3, 5.0)], "src long, dst long, w double")
    got = {(r.src, r.dst): r.w for r in graph.merge_edges(e).collect()}
    assert got == {(1, 2): 0.7, (2, 1): 0.7, (2, 3): 0.1, (3, 2): 0.1}
    assert one(graph.check_symmetric(graph.merge_edges(e))) == (0, 0, 0)


def test_cosine_excludes_self_even_among_duplicates(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    got = {(r.src, r.pos): r.dst for r in graph.cosine_nearest(df, 1, pivots=2).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1}


def test_patches():
    g = np.array([[1, 0, 2], [0, 1, 2], [2, 0, 0]])
    label = raster.patches(g)
    assert label[0, 0] == label[1, 1] and label[0, 2] == label[1, 2] != label[2, 0] and label[0, 1] == 0
    lpi, menn = raster.patch_metrics(g)
    assert lpi == 40.0 and menn == pytest.approx(math.sqrt(5) - 1)
    assert raster.patch_metrics(np.ones((21, 21), int)) == (100.0, 0.0)
    assert raster.patch_metrics(np.array([[1, 0], [0, 0]])) == (None, 0.0)


def test_landscape_shape_of_a_square_is_one(spark):
    px = spark.createDataFrame([(1, r, c, 3) for r in range(21) for c in range(21)], "id long, row long, col long, value long")
    assert one(raster.landscape_shape(px)) == (1, 1.0)


def test_dense_index_and_frontier(spark):
    df = spark.createDataFrame([(k, float((k * 37) % 11)) for k in range(100)], "id long, v double")
    got = [r.id for r in rank.dense_index(df.repartition(7), ["v", "id"]).orderBy("idx").collect()]
    assert got == sorted(range(100), key=lambda k: ((k * 37) % 11, k))
    f = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 6.0), (3, 2.0, 6.0), (4, 3.0, 7.0)], "id long, c double, g double")
    assert {r.id for r in rank.pareto_frontier(f, "c", "g", "id").collect()} == {2, 4}


def test_split_sizes(spark):
    n = {r.split: r["count"] for r in rank.hash_split(spark.range(9130), "id").groupBy("split").count().collect()}
    assert n == {"train": 6391, "val": 1369, "test": 1370}


def test_split_takes_shares_as_decimals(spark):
    n = {r.split: r["count"] for r in rank.hash_split(spark.range(90_000), "id").groupBy("split").count().collect()}
    assert n == {"train": 63_000, "val": 13_500, "test": 13_500}  # 90000 * 0.7 is 62999.99999999999 as a double


def test_silhouette_of_a_single_row_is_zero(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "a"), (3, 9.0, "b")], "id long, v double, l string")
    got = {r.id: r.silhouette for r in cluster.silhouette(df, ["v"], "l").collect()}
    assert got[3] == 0.0 and got[1] == pytest.approx((9 - 1) / 9)


def test_blocked_needs_a_change(spark):
    df = spark.createDataFrame([(0.1, 0.9, 0.5), (0.5, 0.9, 0.5), (0.1, 0.2, 0.5)], "cur double, goal double, built double")
    got = [(round(r.delta, 6), r.blocked) for r in policy.capped_change(df, "cur", "goal", "built").collect()]
    assert got == [(0.3, True), (0.0, False), (0.1, False)]


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = gat.Network(3, 2, hidden=4, heads=2, seed=3)
    g = gat.graph_arrays(6, np.array([0, 1, 2, 3, 4, 0]), np.array([1, 2, 3, 4, 5, 3]), rng.random(6))
    x, y, mask = rng.normal(size=(6, 3)), rng.normal(size=(6, 2)), np.array([1, 1, 0, 1, 1, 1], bool)
    _, grad = net.gradients(x, g, y, mask)
    for k, p in net.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up, _ = net.gradients(x, g, y, mask)
        p[at] = old - 1e-6
        down, _ = net.gradients(x, g, y, mask)
        p[at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7), k


def test_relational_inference_equals_numpy(spark):
    rng = np.random.default_rng(2)
    net = gat.Network(2, 1, hidden=3, heads=2, seed=4)
    src, dst, w = np.array([0, 1, 2, 3, 3]), np.array([1, 2, 0, 0, 1]), rng.random(5)
    x = rng.normal(size=(4, 2))
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    edges = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(src, dst, w)], "src long, dst long, w double")
    first, second = net.layers()
    h = gat.convolve(gat.convolve(nodes, edges, first), edges, second)
    got = np.array([r.x for r in h.orderBy("id").collect()])
    want = net.forward(x, gat.graph_arrays(4, src, dst, w))[1][0]
    assert np.allclose(got, want)


def test_explanations_of_a_linear_predictor():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    beta = np.array([[2.0], [0.0], [-1.0]])
    predict = lambda z: z @ beta
    y, mask = predict(x), np.ones(80, bool)
    fall = {n: v[0] for n, _, v in plain.ablation(predict, x, y, {"a": [0], "b": [1]}, mask)}
    assert fall["a"] > 0.5 and abs(fall["b"]) < 1e-12
    assert plain.permutation_importance(predict, x, y, mask)[1, 0] == pytest.approx(0.0, abs=1e-12)
    phi = plain.shapley(predict, x[:5], np.zeros((1, 3)), samples=4)
    assert np.allclose(phi[:, :, 0], x[:5] * beta[:, 0])
    curve = plain.partial_dependence(predict, x, 0, 5)
    assert curve[-1][1][0] - curve[0][1][0] == pytest.approx(2 * (x[:, 0].max() - x[:, 0].min()))
    fit = plain.mlp(x, y, (8,), epochs=400)
    assert plain.r2(y, fit(x))[0] > 0.95


def test_queries_stand_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys, types
sys.path.insert(0, {str(root)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('latticework.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name='latticework.llm' if name.startswith('lattice') else name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert 'composite_index' in q and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_morans_permutation_can_be_significant(spark):
    from latticework.plans.registry import QUERIES

    side = 12
    nodes = spark.createDataFrame([(i * side + j, float(i + j)) for i in range(side) for j in range(side)], "id long, v double")
    pairs = [(i * side + j, (i + a) * side + j + b, 1.0) for i in range(side) for j in range(side) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < side and 0 <= j + b < side]
    edges = spark.createDataFrame(pairs, "src long, dst long, w double")
    r = stats.morans_p(nodes, edges, "v").first()
    assert abs(r.i - stats.morans_i(nodes, edges, "v").first().i) < 1e-9 and r.p == 0.001
    assert stats.morans_p(nodes.withColumn("v", F.lit(1.0)), edges, "v").count() == 0
    p = QUERIES["morans_permutation"](spark, "/root/testdata/sf0.001").first().p
    assert abs(p * 1000 - round(p * 1000)) < 1e-6


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_order_of_wide_tables_of_many_partitions(spark, coalesce):
    n = 150_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = spark.range(n, numPartitions=8).withColumns({"v": F.pmod(F.xxhash64("id"), F.lit(1000)), "c": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)), "g": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10**9)) + F.col("id"), "wide": F.repeat(F.sha2(F.col("id").cast("string"), 256), 4)})
        plain = df.select("id", "v", "c", "g").toPandas()
        plain["c"] = plain["c"] % 1000 + plain["g"] // 10**3
        place = plain.sort_values(["v", "id"]).id.to_numpy()
        got = rank.dense_index(df, ["v", "id"]).select("idx", "id", F.length("wide").alias("n")).toPandas().sort_values("idx")
        assert got.idx.tolist() == list(range(n)) and (got.id.to_numpy() == place).all() and (got.n == 256).all()

        order = plain.sort_values(["c", "g", "id"], ascending=[True, False, True])
        best = order.g.cummax().shift(fill_value=-1)
        found = rank.pareto_frontier(df.withColumn("c", F.col("c") % 1000 + F.floor(F.col("g") / 10**3)), "c", "g", "id").select("id", F.length("wide").alias("n")).toPandas()
        assert sorted(found.id) == sorted(order.id[order.g > best]) and len(found) > 100

        shares = {r.split: (r.n, r.w) for r in rank.hash_split(df, "id").groupBy("split").agg(F.count("*").alias("n"), F.max(F.length("wide")).alias("w")).collect()}
        assert shares == {"train": (int(n * 0.7), 256), "val": (int(n * 0.15), 256), "test": (n - int(n * 0.7) - int(n * 0.15), 256)}

        ranks = stats.average_ranks(df.select("id", "v", "wide"), ["v"]).select("id", "rank_v", F.length("wide").alias("n")).toPandas().set_index("id").rank_v
        assert (ranks.sort_index().to_numpy() == plain.sort_values("id").v.rank().to_numpy()).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=5000).round(2), rng.integers(0, 9, 5000).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if k % 3 else None, None) for k, (x, y) in enumerate(zip(a, b))], "a double, b double, c double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.85, 1.0]
    row = rank.exact_quantiles(df, ["a", "b", "c"], shares).first()
    assert np.allclose(row.a, np.quantile(a, shares)) and np.allclose(row.b, np.quantile(b[np.arange(5000) % 3 > 0], shares)) and row.c is None


def test_betweenness_counts_shortest_paths(spark):
    rng = np.random.default_rng(8)
    n = 12
    links = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, n, (16, 2)) if p[0] != p[1]})
    near = {v: {b for a, b in links if a == v} | {a for a, b in links if b == v} for v in range(n)}

    def paths(s, t):
        found, level = [], [[s]]
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [p + [v] for p in level for v in near[p[-1]] if v not in p]
        return found

    want = np.zeros(n)
    for s in range(n):
        for t in range(s + 1, n):
            every = paths(s, t)
            for p in every:
                for v in p[1:-1]:
                    want[v] += 1 / len(every)
    nodes, edges = spark.createDataFrame([(v,) for v in range(n)], "id long"), spark.createDataFrame(links, "src long, dst long")
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    assert np.allclose([got[v] for v in range(n)], want)


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_betweenness_by_blocks_equals_levels(spark, blocks):
    rng = np.random.default_rng(blocks)
    near = {(i, i + k) for i in range(150) for k in (1, 2, 9) if i + k < 150 and (i * k) % 5}  # a strip, whose shortest paths cross blocks
    far = {(int(a), int(b)) for a, b in rng.integers(0, 150, (25, 2))} | {(200, 201), (201, 202), (3, 3)}  # leaps, another component and a loop
    edges = spark.createDataFrame(sorted(near | far), "src long, dst long")
    nodes = spark.createDataFrame([(v, (v * blocks // 150) if v % 11 else v % blocks) for v in range(205)], "id long, part long")
    want = {r.id: r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, edges, F.col("part")).collect()}
    assert got.keys() == want.keys() and np.allclose([got[v] for v in want], list(want.values())) and max(want.values()) > 100


def test_betweenness_by_blocks_writes_no_pairs(spark, monkeypatch):
    from latticework.operators import paths

    rows = []
    keep = paths.written
    monkeypatch.setattr(paths, "written", lambda df, label: (rows.append((label, (t := keep(df, label)).count())), t)[1])
    nodes = spark.range(400).withColumn("part", F.floor(F.col("id") / 100))
    edges = spark.range(399).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, edges, F.col("part")).collect()}
    assert all(got[v] == v * (399 - v) for v in range(400)) and sum(n for _, n in rows) < 5 * 400


def test_permuted_fields_by_blocks_equal_plain_ones(spark, monkeypatch):
    from latticework.operators import permute

    monkeypatch.setattr(permute, "PART_ROWS", 16)
    rng = np.random.default_rng(4)
    n, mean = 90, 3.0
    v = [None if k == 7 else float(x) for k, x in enumerate(rng.normal(3, 1, n).round(2))]
    pairs = {(int(a), int(b)): float(w) for (a, b), w in zip(rng.integers(0, n, (300, 2)), rng.uniform(0.5, 2, 300)) if a != b} | {(5, 1000): 1.0, (2000, 6): 2.0}  # ends that are no nodes
    nodes = spark.createDataFrame([(3 * k, x, k % 4) for k, x in enumerate(v)], "id long, v double, part long")
    edges = spark.createDataFrame([(3 * a, 3 * b, w) for (a, b), w in pairs.items()], "src long, dst long, w double")
    total = {a: sum(w for (s, _), w in pairs.items() if s == a) for a, _ in pairs}

    def product(place):
        z = {k: None if v[p] is None else v[p] - mean for k, p in place.items()}
        return sum(w / total[a] * z[a] * z[b] for (a, b), w in pairs.items() if z.get(a) is not None and z.get(b) is not None)

    want = [product({k: k for k in range(n)})]
    for run in range(1, 8):
        order = sorted(range(n), key=lambda k: hashlib.md5(f"{3 * k}:{run}:42".encode()).hexdigest())
        want.append(product({k: p for p, k in enumerate(order)}))
    s0, got = permute.products(nodes, edges, "v", mean, 7, 42, 3, F.col("part"))
    assert abs(s0 - len(total)) < 1e-9 and np.allclose(got, want)
    whole, blocks = (stats.morans_p(nodes, edges, "v", permutations=7, at_once=3, block=b).first() for b in (None, F.col("part")))
    assert abs(whole.i - blocks.i) < 1e-9 and whole.p == blocks.p


def test_permuted_fields_with_equal_bits(spark, monkeypatch):
    from latticework.operators import permute

    keep = permute._digests

    def few(ids, run, seed):
        h = keep(ids, run, seed).copy()
        h[:, 0] &= np.uint64(3 << 62)  # four values, so that second halves decide
        return h

    monkeypatch.setattr(permute, "_digests", few)
    nodes = spark.range(40).select("id", (F.col("id") * 1.5).alias("v"), (F.col("id") % 3).alias("part"))
    edges = spark.range(39).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    _, got = permute.products(nodes, edges, "v", 0.0, 2, 42, 2, F.col("part"))
    for run in (1, 2):
        h = few(list(range(40)), run, 42)
        place = {k: p for p, k in enumerate(sorted(range(40), key=lambda k: (h[k, 0], h[k, 1])))}
        assert abs(got[run] - sum(2.25 * place[k] * place[k + 1] for k in range(39))) < 1e-6


def test_morans_permutation_writes_no_edge_with_a_field(spark, monkeypatch):
    from latticework.operators import permute
    from latticework.plans.registry import QUERIES

    called = []
    keep = permute.products
    monkeypatch.setattr(permute, "products", lambda *a: called.append(1) or keep(*a))
    assert QUERIES["morans_permutation"](spark, "/root/testdata/sf0.001").count() == 1 and called
