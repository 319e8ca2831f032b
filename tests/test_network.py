from __future__ import annotations

import numpy as np
import pytest

from latticework.operators import gat, network, policy
from latticework.plans.network import model

from . import plain


@pytest.fixture(scope="module")
def town(spark):
    """A small random graph, as tables and as arrays."""
    rng = np.random.default_rng(4)
    n = 30
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (45, 2)).tolist() if a != b})
    links = [(a, b, 1.0 / (1 + (a + b) % 3)) for a, b in pairs] + [(b, a, 1.0 / (1 + (a + b) % 3)) for a, b in pairs]
    x = rng.normal(size=(n, 3))
    nodes = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, x array<double>")
    edges = spark.createDataFrame(links, "src long, dst long, w double")
    src, dst, w = (np.array(c) for c in zip(*links, strict=True))
    return nodes, edges, x, gat.graph_arrays(n, src, dst, w)


def test_relational_and_numpy_networks_agree(town):
    nodes, edges, x, graph = town
    got = np.array([r.y for r in network.predict(nodes, edges, model()).orderBy("id").collect()])
    assert np.allclose(got, model().as_network().forward(x, graph)[0])


def test_gains_of_pruned_variants_equal_those_of_the_whole_graph(spark, town):
    nodes, edges, x, graph = town
    net, targets = model().as_network(), [0, 3, 7, 21]
    got = {r.target: r for r in network.shift_gains(spark.createDataFrame([(t,) for t in targets], "id long"), nodes, edges, model(), {0: 1.5, 2: -1.0}, 3, (-1.0, 1.0)).collect()}
    before = net.forward(x, graph)[0]
    for t in targets:
        z = x.copy()
        z[t] += [1.5, 0, -1.0]
        gain = (net.forward(z, graph)[0] - before) * [-1, 1]
        near = sorted(set(graph[1][graph[0] == t]) - {t})
        assert np.allclose([got[t].own_0, got[t].own_1], gain[t]) and np.allclose([got[t].near_0, got[t].near_1], gain[near].sum(0))


def test_search_finds_what_numpy_says_it_is_worth(spark, town):
    nodes, edges, x, graph = town
    options = {"population": 20, "generations": 6}
    row = network.optimise(spark.createDataFrame([(7,)], "id long"), nodes, edges, model(), [0, 1], [(1.0, 4.0), (0.5, 3.5)], main=1, weights=(10.0, 2.0), signs=(-1.0, 1.0), runs=1, **options).first()
    net = model().as_network()
    z = x.copy()
    z[7, :2] += row.genes
    gain = (net.forward(z, graph)[0] - net.forward(x, graph)[0]) * [-1, 1]
    near = sorted(set(graph[1][graph[0] == 7]) - {7})
    assert abs(row.value - (10 * (gain[7, 1] + gain[near, 1].sum()) + 2 * gain[7, 0])) < 1e-9
    assert 1 <= row.genes[0] <= 4 and 0.5 <= row.genes[1] <= 3.5


def test_occlusion_equals_numpy(spark, town):
    nodes, edges, x, graph = town
    got = [(r.src, r.dst, r.change) for r in network.edge_occlusion(spark.createDataFrame([(7,)], "id long"), nodes, edges, model()).orderBy("pos").collect()]
    want = plain.edge_occlusion(model().as_network(), x, graph, 7)
    assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want) and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_shapley_values_add_up(town):
    nodes, _, x, _ = town
    rows = network.shapley(nodes, model(), ["a", "b", "c"]).collect()
    net = model().as_network()
    alone = gat.graph_arrays(len(x), np.array([], int), np.array([], int), np.array([]))
    gap = net.forward(x, alone)[0] - net.forward(np.tile(x.mean(0), (len(x), 1)), alone)[0]
    total = np.zeros_like(gap)
    for r in rows:
        total[r.id] += r.phi
    assert np.allclose(total, gap)


def test_evolution_keeps_the_best_and_the_bounds():
    best, value = policy.evolve(lambda g: -((g - [2.0, 3.0]) ** 2).sum(1), [(0.0, 1.5), (0.0, 9.0)], 1)
    assert best[0] == pytest.approx(1.5, abs=0.02) and best[1] == pytest.approx(3.0, abs=0.3) and value <= -0.25 + 1e-9


def test_draws_are_spread_and_unlike(spark):
    c = np.arange(4000)
    u = [policy.draw(12345, 1, 3, c, k) for k in range(4)]
    for k, x in enumerate(u):
        assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.02 and np.abs(np.bincount((x * 10).astype(int), minlength=10) - 400).max() < 90
        assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.05 and all(abs(np.corrcoef(x, y)[0, 1]) < 0.05 for y in u[:k])


def test_search_is_its_own_brute_force(spark):
    """The same generations, one candidate after another."""
    fitness = lambda c, genes: -((genes - c) ** 2).sum(1)
    bounds, options = [(-1.0, 1.0), (0.5, 3.5)], {"population": 12, "generations": 6, "elite": 3, "mutation": 0.4}
    nodes = spark.createDataFrame([(k, [k / 10, 2.0]) for k in range(5)], "id long, context array<double>")
    for r in policy.genetic_search(nodes, fitness, bounds, run=7, **options).collect():
        c = np.array([r.id / 10, 2.0])
        pop = [[round(lo + (hi - lo) * policy.draw(r.id, 7, 0, i, g), 9) for g, (lo, hi) in enumerate(bounds)] for i in range(12)]
        for step in range(6):
            pop.sort(key=lambda g: -round(fitness(c, np.array([g]))[0], 9))  # noqa: B023
            if step == 5:
                break
            kids = []
            for i in range(3, 12):
                u = lambda k: policy.draw(r.id, 7, step + 1, i, k)  # noqa: B023, E731
                kid = list(pop[int(u(100) * 6)])
                if u(101) < 0.4:
                    kid[int(u(102) * 2)] += 0.5 * np.sqrt(-2 * np.log(max(u(103), 1e-9))) * np.cos(2 * np.pi * u(104))
                kids.append([round(float(np.clip(v, lo, hi)), 9) for v, (lo, hi) in zip(kid, bounds, strict=True)])
            pop = pop[:3] + kids
        assert np.allclose(r.genes, pop[0]) and r.best == pytest.approx(fitness(c, np.array([pop[0]]))[0])
