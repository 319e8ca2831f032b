"""Why a predictor says what it says: Shapley values by weighted least squares over sampled coalitions, and masks learned for the edges and features around a node."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.storage import written

from . import gat
from .network import Model, _around, _looped

#: Rows of features that a predictor gets at once.
ROWS = 100_000


class Alone:
    """The network of a node without edges, for rows of features: its loop has all of its attention."""

    def __init__(self, model: Model):
        self.first, self.second, self.weight, self.bias = model.first, model.second, model.weight, model.bias

    def _rest(self, z: np.ndarray) -> np.ndarray:
        elu = lambda v: np.where(v > 0, v, np.expm1(np.minimum(v, 0)))
        return elu(elu(z) @ self.second.left + self.second.bias) @ self.weight + self.bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._rest(x @ self.first.left + self.first.bias)

    def mixed(self, x: np.ndarray, background: np.ndarray, present: np.ndarray) -> np.ndarray:
        """(rows, background, targets): the present features from x and the others from the background, whose parts of the first layer are added, not worked out for each pair."""
        return self._rest((x[:, present] @ self.first.left[present])[:, None] + (background[:, ~present] @ self.first.left[~present] + self.first.bias))


def alone(model: Model) -> Alone:
    return Alone(model)


def _draw(j: int, f: int) -> int:
    p = 2147483647
    return (((j * 8191 + f + 1) * 48271 + 11) % p * 69621 + 7) % p


def coalitions(features: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Present features (rows of 0 and 1) and weights of at most `most` coalitions (two of each size and its complement at least), without the empty and the full one.

    Sizes have the weight (features - 1) / (size * (features - size)). From the smallest and largest on, sizes whose coalitions all fit in are there as a whole; the weight of the others is
    shared by coalitions drawn from hashes, each with its complement, as often as they come.
    """
    share = {s: (features - 1) / (s * (features - s)) for s in range(1, features)}
    weight: dict[tuple[int, ...], float] = {}
    left, sizes = most, list(range(1, features // 2 + 1))
    while sizes:
        s = sizes[0]
        both = [s] if 2 * s == features else [s, features - s]
        if sum(comb(features, k) for k in both) > left:
            break
        for k in both:
            for c in combinations(range(features), k):
                weight[c] = share[k] / comb(features, k)
        left -= sum(comb(features, k) for k in both)
        sizes.pop(0)
    if sizes and left > 1:
        p = np.array([share[s] * (1 if 2 * s == features else 2) for s in sizes])
        upto, drawn, j = np.cumsum(p) / p.sum(), {}, 0
        while len(drawn) + 2 <= left and j < 40 * most:
            s = sizes[int(np.searchsorted(upto, _draw(j, 0) / 2147483647, side="right"))]
            c = tuple(sorted(sorted(range(features), key=lambda f: (_draw(j, f + 1), f))[:s]))  # noqa: B023
            for one in (c, tuple(sorted(set(range(features)) - set(c)))):
                drawn[one] = drawn.get(one, 0) + 1
            j += 1
        weight |= {c: p.sum() * n / sum(drawn.values()) for c, n in drawn.items()}
    z = np.zeros((len(weight), features))
    for k, c in enumerate(weight):
        z[k, list(c)] = 1
    return z, np.array(list(weight.values()))


def solver(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(features, coalitions + 1): what the coalitions' values, and last the full one's, are multiplied with to give Shapley values; all values less the empty coalition's.

    The weighted normal equations of a linear model whose terms add up to the full value; they depend on coalitions only, so they are solved once.
    """
    a = z[:, :-1] - z[:, -1:]
    m = np.linalg.lstsq((a * w[:, None]).T @ a, (a * w[:, None]).T, rcond=None)[0] if a.shape[1] else np.zeros((0, len(z)))
    first = np.c_[m, -m @ z[:, -1]]
    return np.r_[first, np.r_[-first.sum(0)[:-1], 1 - first.sum(0)[-1]][None]]


def kernel_shapley(rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, weights: np.ndarray, names: list[str], most: int | None = None) -> DataFrame:
    """id, feature, phi (array, one for each target): Shapley values of each row against a weighted background, by at most `most` coalitions (2 * features + 2048).

    The value of a coalition is the mean prediction over the background with the coalition's features from the row. Rows are independent: one map over the table, without a shuffle; a
    background is a few rows (centres of clusters). With all coalitions the values are exact. rows: id, x (array of as many features as there are names).
    """
    size = len(names)
    z, w = coalitions(size, most or 2 * size + 2048)
    solve, share, z = solver(z, w), np.asarray(weights, float) / np.sum(weights), z.astype(bool)
    background = np.asarray(background, float)
    empty = share @ predict(background)
    step = max(1, ROWS // len(background))

    def run(batches):
        for b in batches:
            ids, every = b.column(0), np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            for at in range(0, len(every), step):
                x = every[at : at + step]
                n, full = len(x), predict(x)
                value = np.empty((len(z) + 1, n, full.shape[1]))
                for k, present in enumerate(z):
                    mixed = predict.mixed(x, background, present) if hasattr(predict, "mixed") else predict(np.where(present, x[:, None], background[None]).reshape(-1, size)).reshape(n, len(background), -1)
                    value[k] = np.tensordot(mixed, share, (1, 0))
                value[-1] = full
                phi = np.tensordot(value - empty, solve, (0, 1)).transpose(0, 2, 1)  # rows, features, targets
                who = ids.slice(at, n).take(pa.array(np.repeat(np.arange(n), size)))
                yield pa.RecordBatch.from_arrays([who, pa.array(names * n), pa.array(phi.reshape(n * size, -1).tolist(), pa.list_(pa.float64()))], names=["id", "feature", "phi"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, feature string, phi array<double>")


# --- learned masks

#: What the masks' sizes and entropies cost: sums over edges, means over features.
EDGE_SIZE, EDGE_ENTROPY, FEATURE_SIZE, FEATURE_ENTROPY, TINY = 0.005, 1.0, 1.0, 0.1, 1e-15


def _conv(layer: gat.Layer, x, src, dst, w, scale):
    heads, channels = layer.att.shape
    n = len(x)
    l, r = x @ layer.left, x @ layer.right
    m = (l[src] + r[dst] + w[:, None] * layer.edge).reshape(-1, heads, channels)
    s = (np.where(m > 0, m, gat.SLOPE * m) * layer.att).sum(2)
    top = np.full((n, heads), -np.inf)
    np.maximum.at(top, dst, s)
    ex = np.exp(s - top[dst])
    total = np.zeros((n, heads))
    np.add.at(total, dst, ex)
    alpha, value = ex / total[dst], l[src].reshape(-1, heads, channels)
    out = np.zeros((n, heads, channels))
    np.add.at(out, dst, alpha[:, :, None] * value * scale[:, None, None])
    z = out.reshape(n, -1) + layer.bias
    return np.where(z > 0, z, np.expm1(np.minimum(z, 0))), (m, alpha, value, z)


def _back(layer: gat.Layer, grad, cache, src, dst, scale):
    """Gradients of a layer's input and of the edges' scales."""
    m, alpha, value, z = cache
    n, (heads, channels) = len(z), layer.att.shape
    g = (grad * np.where(z > 0, 1, np.exp(np.minimum(z, 0)))).reshape(n, heads, channels)[dst]
    d_scale = (g * alpha[:, :, None] * value).sum((1, 2))
    d_alpha = (g * value).sum(2) * scale[:, None]
    inner = np.zeros((n, heads))
    np.add.at(inner, dst, alpha * d_alpha)
    d_s = alpha * (d_alpha - inner[dst])
    d_m = (d_s[:, :, None] * layer.att * np.where(m > 0, 1, gat.SLOPE)).reshape(len(src), -1)
    d_l, d_r = np.zeros((n, heads * channels)), np.zeros((n, heads * channels))
    np.add.at(d_l, src, d_m + (alpha[:, :, None] * g * scale[:, None, None]).reshape(len(src), -1))
    np.add.at(d_r, dst, d_m)
    return d_l @ layer.left.T + d_r @ layer.right.T, d_scale


def masked_loss(model: Model, x, graph, at, want, mx, me, counts, masked):
    """Loss of masks for some targets together, with its gradients in them. at: the targets' nodes, one for each graph of a disjoint union; graph: src, dst, w, and the part of the union that an
    edge and a node is of; mx, me: masks of (node, feature) and of edges before the sigmoid; counts, masked: the nodes and edges that have a mask.
    """
    src, dst, w, part, node_part = graph
    sx, se = np.where(counts[:, None], 1 / (1 + np.exp(-mx)), 1.0), 1 / (1 + np.exp(-me))
    scale = np.where(masked, se, 1.0)
    h1, c1 = _conv(model.first, x * sx, src, dst, w, scale)
    h2, c2 = _conv(model.second, h1, src, dst, w, scale)
    gap = h2[at] @ model.weight + model.bias - want
    k = gap.shape[1]
    g2 = np.zeros_like(h2)
    g2[at] = 2 * gap / k @ model.weight.T
    g1, d2 = _back(model.second, g2, c2, src, dst, scale)
    gx, d1 = _back(model.first, g1, c1, src, dst, scale)
    edges, nodes = np.bincount(part[masked], minlength=len(at)), np.bincount(node_part[counts], minlength=len(at)) * x.shape[1]
    entropy = lambda p: -p * np.log(p + TINY) - (1 - p) * np.log(1 - p + TINY)
    slope = lambda p: -np.log(p + TINY) - p / (p + TINY) + np.log(1 - p + TINY) + (1 - p) / (1 - p + TINY)
    per_edge, per_cell = 1 / np.maximum(edges, 1)[part], (counts / nodes[node_part])[:, None]
    loss = (gap * gap).mean(1)
    loss = loss + np.bincount(part, masked * (EDGE_SIZE * se + EDGE_ENTROPY * entropy(se) * per_edge), minlength=len(at))
    loss = loss + np.bincount(node_part, ((FEATURE_SIZE * sx + FEATURE_ENTROPY * entropy(sx)) * per_cell).sum(1), minlength=len(at))
    d_edge = masked * (d1 + d2 + EDGE_SIZE + EDGE_ENTROPY * slope(se) * per_edge) * se * (1 - se)
    d_x = (gx * x + (FEATURE_SIZE + FEATURE_ENTROPY * slope(sx)) * per_cell) * sx * (1 - sx)
    return loss, d_x, d_edge


def _hashed_normal(a: np.ndarray, b: np.ndarray, c: int) -> np.ndarray:
    """Normal numbers that depend on their place only."""
    p = 2147483647
    u = [(((a.astype(object) * 48271 + b * 8191 + c + k) % p * 69621 + 11) % p * 48271 % p).astype(float) / p for k in (1, 500_009)]
    return np.sqrt(-2 * np.log(np.maximum(u[0], 1e-9))) * np.cos(2 * np.pi * u[1])


def read_by(at, src, dst, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and the edges (loops apart) that two layers' answers at these nodes depend on."""
    near = np.zeros(n, bool)
    near[at] = True
    near[src[near[dst]]] = True
    nodes = near.copy()
    nodes[src[near[dst]]] = True
    return nodes, near[dst] & (src != dst)


def learn_masks(model: Model, x, graph, at, ids, epochs: int = 200, rate: float = 0.01):
    """Masks (after the sigmoid) of nodes' features and of edges after Adam on masked_loss; what an answer doesn't depend on has 0. ids: the nodes', which starting values are hashed from."""
    src, dst, w, part, node_part = graph
    counts, masked = read_by(at, src, dst, len(x))
    h1, _ = _conv(model.first, x, src, dst, w, np.ones(len(src)))
    h2, _ = _conv(model.second, h1, src, dst, w, np.ones(len(src)))
    want = h2[at] @ model.weight + model.bias
    nodes = np.bincount(node_part, minlength=len(at))
    mx = 0.1 * _hashed_normal(np.repeat(ids[:, None], x.shape[1], 1), np.arange(x.shape[1])[None].repeat(len(x), 0), 3)
    me = np.sqrt(2.0 / nodes[part]) * _hashed_normal(ids[src], ids[dst], 7)
    state = [[np.zeros_like(m), np.zeros_like(m)] for m in (mx, me)]
    for t in range(1, epochs + 1):
        _, dx, de = masked_loss(model, x, graph, at, want, mx, me, counts, masked)
        for m, d, s in ((mx, dx, state[0]), (me, de, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * d
            s[1] = 0.999 * s[1] + 0.001 * d * d
            m -= rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
    return np.where(counts[:, None], 1 / (1 + np.exp(-mx)), 0.0), np.where(masked, 1 / (1 + np.exp(-me)), 0.0)


def explain(targets: DataFrame, nodes: DataFrame, edges: DataFrame, model: Model, names: list[str], *, top: int = 10, epochs: int = 200, rate: float = 0.01) -> DataFrame:
    """target, edges (array of src, dst, mask: the `top` edges of largest masks, by mask and ends), features (array of feature, mask: the means over the nodes that count).

    Each target's surroundings, two steps deep, travel as arrays (their size is the square of a node's edges, not the graph's); all targets of an Arrow batch learn together, as one graph
    of parts that aren't linked. Starting values are hashes of ids, so a target's masks are the same in any batch.
    """
    inner, ids = _around(targets, _looped(targets, nodes, edges))
    n = ids.join(nodes.select("id", "x"), "id").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("nodes"))
    e = inner.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "w"))).alias("edges"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                yield _explained(b.slice(lo, 64), model, names, top, epochs, rate)

    kind = nodes.schema["id"].dataType.simpleString()
    schema = f"target {kind}, edges array<struct<src:{kind},dst:{kind},mask:double>>, features array<struct<feature:string,mask:double>>"
    return n.join(e, "target").select("target", "nodes", "edges").mapInArrow(run, schema)


def _explained(b: pa.RecordBatch, model: Model, names: list[str], top: int, epochs: int, rate: float) -> pa.RecordBatch:
    targets, ids, x, at, node_part, links = b.column(0).to_pylist(), [], [], [], [], []
    for k, (t, nodes, edges) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
        number = {r["id"]: len(ids) + i for i, r in enumerate(nodes)}
        at.append(number[t])
        ids += [r["id"] for r in nodes]
        x += [r["x"] for r in nodes]
        node_part += [k] * len(nodes)
        links += [(number[r["src"]], number[r["dst"]], r["w"], k) for r in edges]
    src, dst, w, part = (np.array(c) for c in zip(*links, strict=True))
    graph = src, dst, w.astype(float), part, np.array(node_part)
    mx, me = learn_masks(model, np.array(x, float), graph, np.array(at), np.array(ids, object), epochs, rate)
    found, features = [], []
    for k in range(len(targets)):
        mine = np.flatnonzero((part == k) & (me > 0))
        best = sorted(mine, key=lambda e: (-round(me[e], 9), ids[src[e]], ids[dst[e]]))[:top]
        found.append([{"src": ids[src[e]], "dst": ids[dst[e]], "mask": float(me[e])} for e in best])
        own = mx[(graph[4] == k) & (mx[:, 0] > 0)]
        features.append([{"feature": f, "mask": float(v)} for f, v in zip(names, own.mean(0), strict=True)])
    kind = b.column(0).type
    edge = pa.list_(pa.struct([("src", kind), ("dst", kind), ("mask", pa.float64())]))
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, edge), pa.array(features, pa.list_(pa.struct([("feature", pa.string()), ("mask", pa.float64())])))], names=["target", "edges", "features"])
