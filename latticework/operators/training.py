"""Training networks where their data lie: each step is a job over blocks of the graph that adds up gradients.

Blocks are those of `blocks`, packed as rows of arrays. Blocks are made
and written once. In a step, tasks hold the weights, run numpy forward and back through their blocks, and give one row of sums; rows are added in a tree, and the driver gets a few of them,
as long as the weights, whatever the size of the graph. The sums over blocks are those over the graph, so steps are the same as on one machine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.storage import written

from . import blocks, gat
from .network import Model, of_network

ROLES = {"train": 1, "val": 2}
#: Rows of sums that the driver may get in a step.
FAN_IN = 16


def blocks_of(nodes: DataFrame, edges: DataFrame, block: Column) -> DataFrame:
    """x, y (by rows, in one array), role (0, or what ROLES says of own nodes), src, dst (places in x), w: written. nodes: id, x, truth, split; block: an expression of nodes' columns.

    Blocks of near nodes share most of what they depend on; a block has to fit in a task.
    """
    base = written(nodes.select("id", "x", "truth", _role().alias("role"), block.alias("block")), "nodes")

    def packed(batches):
        for b in blocks.read(batches):
            yield _packed(b.x, np.nan_to_num(b.truth), b.role, b.graph)

    return written(blocks.grouped(base, edges, F.col("block")).mapInArrow(packed, _SCHEMA), "blocks")


_FLOATS, _INTS = pa.list_(pa.float64()), pa.list_(pa.int32())
_PACKED = {"x": _FLOATS, "y": _FLOATS, "role": _INTS, "src": _INTS, "dst": _INTS, "w": _FLOATS}
_SCHEMA = "x array<double>, y array<double>, role array<int>, src array<int>, dst array<int>, w array<double>"


def _role() -> Column:
    return F.coalesce(*(F.when(F.col("split") == n, F.lit(k)) for n, k in ROLES.items()), F.lit(0))


def _packed(x: np.ndarray, y: np.ndarray, role: np.ndarray, graph: tuple) -> pa.RecordBatch:
    flat = zip((x, y, role, *graph), _PACKED.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel(), k.value_type)) for v, k in flat], names=list(_PACKED))


def rows_of(nodes: DataFrame, rows: int = 10_000) -> DataFrame:
    """As blocks_of, for predictors that don't read edges: any rows together."""

    def packed(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                x, y = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
                yield _packed(x, y, part.column(2).to_numpy(zero_copy_only=False), (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)))

    lean = nodes.select("x", F.col("truth").alias("y"), _role().alias("role")).where("role > 0")
    return written(lean.mapInArrow(packed, _SCHEMA), "rows")


class Perceptron:
    """Layers with ReLU between them; as gat.Network, but without edges."""

    def __init__(self, inputs: int, targets: int, hidden: tuple[int, ...] = (64, 32), seed: int = 42):
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, targets]
        self.depth = len(sizes) - 1
        self.p = {f"w{k}": rng.normal(0, np.sqrt(2 / a), (a, b)) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))} | {f"b{k}": np.zeros(b) for k, b in enumerate(sizes[1:])}

    def forward(self, x, graph=None):
        acts = [x]
        for k in range(self.depth):
            z = acts[-1] @ self.p[f"w{k}"] + self.p[f"b{k}"]
            acts.append(np.maximum(z, 0) if k < self.depth - 1 else z)
        return acts[-1], acts

    def back(self, g, acts, graph) -> dict:
        out = {}
        for k in reversed(range(self.depth)):
            out[f"w{k}"], out[f"b{k}"] = acts[k].T @ g, g.sum(0)
            g = (g @ self.p[f"w{k}"].T) * (acts[k] > 0)
        return out


def _network_back(net: gat.Network, g, caches, graph) -> dict:
    h2, c1, c2 = caches
    src, dst, w = graph
    out = {"w": h2.T @ g, "b": g.sum(0)}
    back = net._back(g @ net.p["w"].T, c2, src, dst, w, len(h2), 2, 1, out)
    net._back(back, c1, src, dst, w, len(h2), 1, net.heads, out)
    return out


def block_sums(net, x, graph, y, role) -> np.ndarray:
    """Squared errors and rows of the two roles, then the gradient of the training rows' squared errors, in the order of the weights."""
    pred, caches = net.forward(x, graph)
    e, train, val = pred - y, role == 1, role == 2
    g = 2 * np.where(train[:, None], e, 0.0)
    back = net.back(g, caches, graph) if isinstance(net, Perceptron) else _network_back(net, g, caches, graph)
    return np.concatenate([[(e[train] ** 2).sum(), train.sum(), (e[val] ** 2).sum(), val.sum()], *(back[k].ravel() for k in net.p)])


def _added(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        total = np.zeros(width)
        for b in batches:
            for v in b.column(0):
                total += v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], _FLOATS)], names=["v"])

    return run


def sums(packed: DataFrame, net) -> np.ndarray:
    """block_sums over all blocks."""
    width = 4 + sum(p.size for p in net.p.values())

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            for k in range(b.num_rows):
                x, y, role, src, dst, w = (c[k].values.to_numpy(zero_copy_only=False) for c in b.columns)
                total += block_sums(net, x.reshape(len(role), -1), (src, dst, w), y.reshape(len(role), -1), role)
        yield pa.RecordBatch.from_arrays([pa.array([total], _FLOATS)], names=["v"])

    rows = packed.select("x", "y", "role", "src", "dst", "w").mapInArrow(run, "v array<double>")
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        rows = rows.repartition(parts).mapInArrow(_added(width), "v array<double>")
    total = np.zeros(width)
    for r in rows.collect():  # FAN_IN rows at most
        total += r.v
    return total


def train(net, packed: DataFrame, *, epochs: int = 800, rate: float = 1e-3, decay: float = 1e-4, clip: float | None = 1.0, patience: int | None = 60, stale: int = 20) -> list[float]:
    """Adam on the mean squared error of the training rows, gradient norm clipped; the rate is halved after `stale` epochs without progress on the validation rows, down to 1e-6, and training
    ends after `patience` of them with the best weights restored. Without patience, all epochs run and the last weights stay. Gives the validation error after each epoch.

    The job that takes the gradient at some weights also gives their validation error, so an epoch is one job.
    """
    targets = (packed.select(F.size("y") / F.size("role")).first() or [1])[0]
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    best, kept, wait, losses = np.inf, None, 0, []
    for t in range(1, epochs + 2):
        s = sums(packed, net)
        if t > 1:
            losses.append(float(s[2] / (s[3] * targets)) if s[3] else float("nan"))
            if losses[-1] < best - 1e-6:
                best, kept, wait = losses[-1], {k: p.copy() for k, p in net.p.items()}, 0
            else:
                wait += 1
                if patience and wait % stale == 0:
                    rate = max(1e-6, rate / 2)
                if patience and wait >= patience:
                    break
        if t > epochs:
            break
        at, g = 4, {}
        for k, p in net.p.items():
            g[k] = s[at : at + p.size].reshape(p.shape) / (s[1] * targets)
            at += p.size
        norm = np.sqrt(sum((d * d).sum() for d in g.values()))
        for k, p in net.p.items():
            d = g[k] * (min(1.0, clip / (norm + 1e-6)) if clip else 1.0) + decay * p
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    if patience and kept:
        net.p = kept
    return losses


def network_of(nodes: DataFrame, edges: DataFrame, block: Column, *, hidden: int = 64, heads: int = 4, seed: int = 42, **options) -> tuple[Model, list[float]]:
    """A trained network and its validation errors. nodes: id, x, truth, split."""
    packed = blocks_of(nodes, edges, block)
    inputs, targets = nodes.select(F.size("x"), F.size("truth")).first()
    net = gat.Network(inputs, targets, hidden=hidden, heads=heads, seed=seed)
    losses = train(net, packed, **options)
    return of_network(net), losses


def perceptron_of(nodes: DataFrame, *, hidden: tuple[int, ...] = (64, 32), epochs: int = 300, rate: float = 1e-2, seed: int = 42) -> Perceptron:
    """A multi-layer perceptron on the training rows."""
    inputs, targets = nodes.select(F.size("x"), F.size("truth")).first()
    net = Perceptron(inputs, targets, hidden, seed)
    train(net, rows_of(nodes.where("split = 'train'")), epochs=epochs, rate=rate, decay=0.0, clip=None, patience=None)
    return net


def perceptron_predict(nodes: DataFrame, net: Perceptron) -> DataFrame:
    """id, y."""

    def run(batches):
        for b in batches:
            y = net.forward(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y.tolist(), _FLOATS)], names=["id", "y"])

    return nodes.select("id", "x").mapInArrow(run, f"id {nodes.schema['id'].dataType.simpleString()}, y array<double>")
