from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import gat, network, training

from . import plain


@pytest.fixture(scope="module")
def town(spark):
    rng = np.random.default_rng(7)
    n = 40
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (70, 2)).tolist() if a != b})
    links = [(a, b, 1.0 / (1 + (a + b) % 3)) for p, q in pairs for a, b in ((p, q), (q, p))]
    x = rng.normal(size=(n, 4))
    y = np.c_[np.tanh(x[:, 0] + x[:, 1]), x[:, 2] * 0.5 - x[:, 3]]
    split = ["train" if k % 10 < 6 else "val" if k % 10 < 8 else "test" for k in range(n)]
    nodes = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist(), split[k]) for k in range(n)], "id long, x array<double>, truth array<double>, split string")
    src, dst, w = (np.array(c) for c in zip(*links, strict=True))
    mask = {s: np.array([v == s for v in split]) for s in ("train", "val")}
    return nodes, spark.createDataFrame(links, "src long, dst long, w double"), x, gat.graph_arrays(n, src, dst, w), y, mask


def test_sums_over_blocks_are_the_graphs_gradients(town):
    nodes, edges, x, graph, y, mask = town
    net = gat.Network(4, 2, hidden=3, heads=2, seed=5)
    loss, want = net.gradients(x, graph, y, mask["train"])
    size = mask["train"].sum() * 2
    for blocks in (1, 5, 40):
        s = training.sums(training.blocks_of(nodes, edges, F.col("id") % blocks), net)
        assert s[0] / size == pytest.approx(loss) and s[1] == mask["train"].sum() and s[3] == mask["val"].sum()
        assert np.allclose(s[4:] / size, np.concatenate([want[k].ravel() for k in net.p]))


def test_training_equals_that_on_one_machine(town):
    nodes, edges, x, graph, y, mask = town
    options = {"epochs": 12, "rate": 2e-2, "patience": 60, "stale": 3}
    here = gat.Network(4, 2, hidden=3, heads=2, seed=5)
    want = plain.train(here, x, graph, y, mask["train"], mask["val"], **options)
    model, losses = training.network_of(nodes, edges, F.col("id") % 6, hidden=3, heads=2, seed=5, **options)
    assert np.allclose(losses, want)
    assert all(np.allclose(model.as_network().p[k], p) for k, p in here.p.items())
    got = np.array([r.y for r in network.predict(nodes, edges, model).orderBy("id").collect()])
    assert np.allclose(got, here.forward(x, graph)[0])


def test_training_ends_after_patience_with_the_best_weights(town):
    nodes, edges, *_ = town
    packed = training.blocks_of(nodes, edges, F.lit(0))
    net = gat.Network(4, 2, hidden=2, heads=1, seed=1)
    losses = training.train(net, packed, epochs=30, rate=1.5, patience=3)
    assert len(losses) < 30 and len(losses) - 1 - int(np.argmin(losses)) == 3
    s = training.sums(packed, net)
    assert s[2] / (2 * s[3]) == pytest.approx(min(losses))


def test_perceptron_equals_numpy(town):
    nodes, _, x, _, y, mask = town
    net = training.perceptron_of(nodes.repartition(5), hidden=(6, 3), epochs=8, rate=5e-2, seed=3)
    want = plain.mlp(x[mask["train"]], y[mask["train"]], (6, 3), epochs=8, rate=5e-2, seed=3)(x)
    got = np.array([r.y for r in training.perceptron_predict(nodes, net).orderBy("id").collect()])
    assert np.allclose(got, want)


def test_many_partitions_are_added_in_a_tree(town, monkeypatch):
    nodes, edges, *_ = town
    monkeypatch.setattr(training, "FAN_IN", 3)
    net = gat.Network(4, 2, hidden=3, heads=2, seed=5)
    packed = training.blocks_of(nodes, edges, F.col("id") % 20)
    assert np.allclose(training.sums(packed.repartition(17), net), training.sums(packed.coalesce(1), net))


def test_baselines_are_trained_as_long_as_the_networks_defaults(spark, sf, monkeypatch):
    """The comparison's network and perceptron have the sizes and epochs of their operators' whole job."""
    from latticework.plans import QUERIES

    asked, real = [], training.train

    def once(net, packed, **options):
        asked.append((type(net).__name__, [p.shape for p in net.p.values()], options["epochs"], options.get("patience", 60)))
        return real(net, packed, **options | {"epochs": 1})

    monkeypatch.setattr(training, "train", once)
    assert {r.label for r in QUERIES["baseline_comparison"](spark, sf).collect()} == {"network", "self_loops", "ols", "mlp"}
    network_, perceptron = asked
    assert network_[0] == "Network" and network_[1][:2] == [(15, 256), (15, 256)] and network_[2:] == (800, 60)
    assert perceptron[0] == "Perceptron" and perceptron[1][:3] == [(15, 64), (64, 32), (32, 2)] and perceptron[2:] == (500, None)
