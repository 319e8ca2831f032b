from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import explain, gat, network
from latticework.plans.explain import wide_model
from latticework.plans.network import model


@pytest.fixture(scope="module")
def town(spark):
    rng = np.random.default_rng(4)
    n = 30
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (45, 2)).tolist() if a != b})
    links = [(a, b, 1.0 / (1 + (a + b) % 3)) for p, q in pairs for a, b in ((p, q), (q, p))]
    x = rng.normal(size=(n, 3))
    nodes = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, x array<double>")
    src, dst, w = (np.array(c) for c in zip(*links, strict=True))
    return nodes, spark.createDataFrame(links, "src long, dst long, w double"), x, gat.graph_arrays(n, src, dst, w)


def test_a_node_alone_is_the_network_without_edges():
    m, x = wide_model(), np.random.default_rng(1).normal(size=(9, 15))
    none = np.array([], int)
    assert np.allclose(explain.alone(m)(x), m.as_network().forward(x, gat.graph_arrays(9, none, none, none.astype(float)))[0])


def test_coalitions_and_weights():
    z, w = explain.coalitions(4, 14)  # all of them
    assert len({tuple(r) for r in z}) == 14 and sorted({int(r.sum()) for r in z}) == [1, 2, 3]
    assert all(v == pytest.approx(3 / (s * (4 - s)) / {1: 4, 2: 6, 3: 4}[s]) for v, s in zip(w, z.sum(1), strict=True))
    z, w = explain.coalitions(15, 128)
    assert len(z) <= 128 and len({tuple(r) for r in z}) == len(z) and sum(r.sum() in (1, 14) for r in z) == 30
    assert w.sum() == pytest.approx(sum(14 / (s * (15 - s)) for s in range(1, 15)))
    assert all(tuple(1 - r) in {tuple(q) for q in z} for r in z)


def test_all_coalitions_give_exact_values(town):
    """Against one background row, the mean, kernel values are the exact ones."""
    nodes, _, x, _ = town
    names = ["a", "b", "c"]
    want = {(r.id, r.feature): r.phi for r in network.shapley(nodes, model(), names).collect()}
    one = explain.alone(model())
    for predict in (one, lambda z: one(z)):  # by its own way of mixing rows, and by whole rows
        got = {(r.id, r.feature): r.phi for r in explain.kernel_shapley(nodes, predict, x.mean(0)[None], [1.0], names).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def exact(predict, x, background, share):
    """Shapley values of one row by all coalitions."""
    from math import factorial

    m = len(x)
    value = {s: share @ predict(np.where([bool(s >> k & 1) for k in range(m)], x, background)) for s in range(1 << m)}
    weight = lambda s: factorial(s.bit_count()) * factorial(m - s.bit_count() - 1) / factorial(m)
    return np.array([sum(weight(s) * (value[s | 1 << k] - value[s]) for s in range(1 << m) if not s >> k & 1) for k in range(m)])


def test_sampled_coalitions_come_near_and_add_up(spark):
    """Eight features of fifteen differ from the background's: 600 coalitions against all 256 of the eight."""
    rng = np.random.default_rng(2)
    background, share = rng.normal(size=(5, 15)), np.array([3, 1, 1, 2, 1]) / 8
    background[:, 8:] = 0.5
    x = rng.normal(size=(6, 15))
    x[:, 8:] = 0.5
    predict, names = explain.alone(wide_model()), [f"f{k}" for k in range(15)]
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>")
    got = {r.id: np.array(r.phi) for r in explain.kernel_shapley(rows, predict, background, share, names, 1200).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("feature", 2, 9).cast("int").alias("k"), "phi"))), lambda s: s["phi"]).alias("phi")).collect()}
    for k in range(6):
        want = exact(lambda z: predict(np.c_[z, np.full((len(z), 7), 0.5)]), x[k, :8], background[:, :8], share)
        size = np.abs(want).max()
        assert np.allclose(got[k].sum(0), predict(x[k : k + 1])[0] - share @ predict(background))
        assert np.abs(got[k][:8] - want).max() < 0.06 * size and np.abs(got[k][8:]).max() < 0.06 * size


def test_gradients_of_masks_equal_finite_differences(town):
    _, _, x, (src, dst, w) = town
    rng, m = np.random.default_rng(5), model()
    graph = src, dst, w, np.zeros(len(src), int), np.zeros(len(x), int)
    at = np.array([7])
    counts, masked = explain.read_by(at, src, dst, len(x))
    mx, me, want = rng.normal(size=x.shape), rng.normal(size=len(src)), np.array([[0.3, -0.2]])
    loss = lambda a, b: explain.masked_loss(m, x, graph, at, want, a, b, counts, masked)[0][0]
    _, dx, de = explain.masked_loss(m, x, graph, at, want, mx, me, counts, masked)
    h = 1e-6
    for e in rng.choice(len(src), 25, replace=False):
        up, down = me.copy(), me.copy()
        up[e] += h
        down[e] -= h
        assert de[e] == pytest.approx((loss(mx, up) - loss(mx, down)) / (2 * h), abs=1e-7)
    for i, f in [(7, 0), (7, 2), *((int(i), int(rng.integers(3))) for i in rng.choice(len(x), 15, replace=False))]:
        up, down = mx.copy(), mx.copy()
        up[i, f] += h
        down[i, f] -= h
        assert dx[i, f] == pytest.approx((loss(up, me) - loss(down, me)) / (2 * h), abs=1e-7)


def test_masks_are_the_same_alone_and_together_and_lower_the_loss(spark, town):
    nodes, edges, x, (src, dst, w) = town
    ask = lambda ts: {r.target: r for r in explain.explain(spark.createDataFrame([(t,) for t in ts], "id long"), nodes, edges, model(), ["a", "b", "c"], epochs=60).collect()}
    t = int(np.bincount(dst).argmax())
    together, single = ask([(t + 1) % 30, t, (t + 5) % 30]), ask([t])
    assert [(e.src, e.dst) for e in together[t].edges] == [(e.src, e.dst) for e in single[t].edges]
    assert np.allclose([e.mask for e in together[t].edges], [e.mask for e in single[t].edges]) and np.allclose([f.mask for f in together[t].features], [f.mask for f in single[t].features])
    near = set(src[dst == t].tolist()) | {t}
    assert 0 < len(single[t].edges) <= 10 and all(e.dst in near and e.src != e.dst and 0 < e.mask < 1 for e in single[t].edges)
    assert [e.mask for e in single[t].edges] == sorted((e.mask for e in single[t].edges), reverse=True)
    graph = src, dst, w, np.zeros(len(src), int), np.zeros(len(x), int)
    at, ids = np.array([t]), np.arange(len(x)).astype(object)
    want = model().as_network().forward(x, (src, dst, w))[0][at]
    logit = lambda p: np.log(np.clip(p, 1e-12, 1 - 1e-12) / (1 - np.clip(p, 1e-12, 1 - 1e-12)))
    counts, masked = explain.read_by(at, src, dst, len(x))
    losses = [explain.masked_loss(model(), x, graph, at, want, *(logit(p) for p in explain.learn_masks(model(), x, graph, at, ids, n)), counts, masked)[0][0] for n in (0, 60, 200)]
    assert losses[0] > losses[1] > losses[2]


def test_an_edge_that_decides_everything_comes_first(spark):
    """Node 0 hears nodes 1 to 5; only 1 has a signal, which the answer is made of."""
    one = lambda v: np.array([[v]])
    layer = gat.Layer(one(1.0), one(0.0), np.array([0.0]), one(0.0), np.array([0.0]))
    m = network.Model(layer, layer, one(10.0), np.array([0.0]))
    nodes = spark.createDataFrame([(k, [5.0 if k == 1 else 0.0]) for k in range(6)], "id long, x array<double>")
    edges = spark.createDataFrame([(k, 0, 1.0) for k in range(1, 6)], "src long, dst long, w double")
    (row,) = explain.explain(spark.createDataFrame([(0,)], "id long"), nodes, edges, m, ["x"]).collect()
    assert (row.edges[0].src, row.edges[0].dst) == (1, 0) and row.edges[0].mask > 2 * row.edges[1].mask
