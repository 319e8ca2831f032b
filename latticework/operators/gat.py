"""A two-layer graph attention network over edge tables: relational inference, and the same network in numpy with its gradients, for blocks of a graph.

Score of edge j -> i and head: a . LeakyReLU(L x_j + R x_i + E w_ij), softmax over the edges that come in, and the weighted sum of L x_j. Each node has a loop whose weight is the
mean of the weights that come in (0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.expr import dot
from latticework.storage import written

SLOPE = 0.2


@dataclass
class Layer:
    left: np.ndarray  # (in, heads * channels)
    right: np.ndarray
    edge: np.ndarray  # (heads * channels,)
    att: np.ndarray  # (heads, channels)
    bias: np.ndarray


def with_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("src <> dst").select("src", "dst", "w")
    mean = e.groupBy("dst").agg(F.avg("w").alias("w"))
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).join(mean, "dst", "left").select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"))
    return e.unionByName(loops)


def _vector(v) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


#: Products that an expression spells out, so that they are compiled; larger ones loop over arrays.
SPELLED = 512


def total(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def times(matrix: np.ndarray, x: Column) -> Column:
    if matrix.size <= SPELLED:
        return F.array(*(total(x[i] * F.lit(float(matrix[i, k])) for i in range(matrix.shape[0])) for k in range(matrix.shape[1])))
    return F.array(*(dot(_vector(matrix[:, k]), x) for k in range(matrix.shape[1])))


def _scores(layer: Layer) -> Column:
    """For each head its number, score and value, from l, r and w of an edge."""
    heads, channels = layer.att.shape
    part = lambda c, h: F.slice(c, h * channels + 1, channels)
    if heads * channels <= SPELLED // 8:
        mixed = lambda k: F.col("l")[k] + F.col("r")[k] + F.lit(float(layer.edge[k])) * F.col("w")
        act = lambda k: F.when(mixed(k) > 0, mixed(k)).otherwise(SLOPE * mixed(k))
        score = lambda h: total(F.lit(float(layer.att[h, c])) * act(h * channels + c) for c in range(channels))
    else:
        sums = F.zip_with(F.zip_with("l", "r", lambda a, b: a + b), _vector(layer.edge), lambda a, c: a + c * F.col("w"))
        leaky = F.transform(sums, lambda v: F.when(v > 0, v).otherwise(SLOPE * v))
        score = lambda h: dot(_vector(layer.att[h]), part(leaky, h))
    return F.array(*(F.struct(F.lit(h).alias("head"), score(h).alias("s"), part("l", h).alias("value")) for h in range(heads)))


def attention(nodes: DataFrame, edges: DataFrame, layer: Layer, loops: bool = True) -> DataFrame:
    """src, dst, head, alpha, value (array: L x_src of that head). nodes: id, x (array). Softmax maxima and sums are aggregated for (dst, head) before the shuffle. loops: to add them."""
    p = nodes.select("id", times(layer.left, F.col("x")).alias("l"), times(layer.right, F.col("x")).alias("r"))
    e = (with_loops(nodes, edges) if loops else edges.select("src", "dst", "w")).join(p.select(F.col("id").alias("src"), "l"), "src").join(p.select(F.col("id").alias("dst"), "r"), "dst")
    e = written(e.select("src", "dst", F.explode(_scores(layer)).alias("q")).select("src", "dst", "q.*"), "scores")  # read three times
    top = e.groupBy("dst", "head").agg(F.max("s").alias("top"))
    e = e.join(top, ["dst", "head"]).withColumn("ex", F.exp(F.col("s") - F.col("top")))
    total = e.groupBy("dst", "head").agg(F.sum("ex").alias("total"))
    return e.join(total, ["dst", "head"]).select("src", "dst", "head", (F.col("ex") / F.col("total")).alias("alpha"), "value")


def convolve(nodes: DataFrame, edges: DataFrame, layer: Layer, elu: bool = True, loops: bool = True) -> DataFrame:
    """id, x: the layer's output."""
    channels = layer.att.shape[1]
    summed = attention(nodes, edges, layer, loops).groupBy("dst", "head").agg(F.array(*(F.sum(F.col("alpha") * F.col("value")[c]) for c in range(channels))).alias("v"))
    out = summed.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("head", "v"))).alias("o"))
    x = F.zip_with(F.flatten(F.transform("o", lambda s: s["v"])), _vector(layer.bias), lambda v, b: v + b)
    return out.select(F.col("dst").alias("id"), (F.transform(x, lambda v: F.when(v > 0, v).otherwise(F.expm1(v))) if elu else x).alias("x"))


# --- numpy: the same network with gradients


def _per(f: np.ufunc, dst: np.ndarray, v: np.ndarray, n: int, empty: float) -> np.ndarray:
    """f over the rows of v of each dst: runs, where edges are sorted by it."""
    out = np.full((n, *v.shape[1:]), empty)
    if len(dst) and (dst[1:] >= dst[:-1]).all():
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        out[dst[first]] = f.reduceat(v, first)
    else:
        f.at(out, dst, v)
    return out


class Network:
    def __init__(self, inputs: int, targets: int, hidden: int = 64, heads: int = 4, seed: int = 42):
        rng = np.random.default_rng(seed)
        g = lambda a, b: rng.normal(0, np.sqrt(2.0 / (a + b)), (a, b))
        wide = hidden * heads
        self.heads, self.hidden = heads, hidden
        self.p = {"l1": g(inputs, wide), "r1": g(inputs, wide), "e1": g(1, wide)[0], "a1": g(heads, hidden), "b1": np.zeros(wide), "l2": g(wide, hidden), "r2": g(wide, hidden), "e2": g(1, hidden)[0], "a2": g(1, hidden), "b2": np.zeros(hidden), "w": g(hidden, targets), "b": np.zeros(targets)}

    def layers(self) -> tuple[Layer, Layer]:
        p = self.p
        return Layer(p["l1"], p["r1"], p["e1"], p["a1"], p["b1"]), Layer(p["l2"], p["r2"], p["e2"], p["a2"], p["b2"])

    def _conv(self, x, src, dst, w, n, k, heads):
        p = self.p
        l, r = x @ p[f"l{k}"], x @ p[f"r{k}"]
        c = l.shape[1] // heads
        m = (l[src] + r[dst] + w[:, None] * p[f"e{k}"]).reshape(-1, heads, c)
        act = np.where(m > 0, m, SLOPE * m)
        s = (act * p[f"a{k}"]).sum(2)
        ex = np.exp(s - _per(np.maximum, dst, s, n, -np.inf)[dst])
        alpha = ex / _per(np.add, dst, ex, n, 0.0)[dst]
        value = l[src].reshape(-1, heads, c)
        out = _per(np.add, dst, alpha[:, :, None] * value, n, 0.0)
        z = out.reshape(n, -1) + p[f"b{k}"]
        return np.where(z > 0, z, np.expm1(np.minimum(z, 0))), (x, m, act, alpha, value, z)

    def _back(self, grad, cache, src, dst, w, n, k, heads, out):
        p = self.p
        x, m, act, alpha, value, z = cache
        grad = grad * np.where(z > 0, 1, np.exp(np.minimum(z, 0)))
        out[f"b{k}"] = grad.sum(0)
        g = grad.reshape(n, heads, -1)[dst]
        d_alpha = (g * value).sum(2)
        inner = _per(np.add, dst, alpha * d_alpha, n, 0.0)
        d_s = alpha * (d_alpha - inner[dst])
        out[f"a{k}"] = (d_s[:, :, None] * act).sum(0)
        d_m = (d_s[:, :, None] * p[f"a{k}"] * np.where(m > 0, 1, SLOPE)).reshape(len(src), -1)
        out[f"e{k}"] = (d_m * w[:, None]).sum(0)
        by = np.argsort(src, kind="stable")
        d_l = _per(np.add, src[by], (d_m + (alpha[:, :, None] * g).reshape(len(src), -1))[by], n, 0.0)
        d_r = _per(np.add, dst, d_m, n, 0.0)
        out[f"l{k}"], out[f"r{k}"] = x.T @ d_l, x.T @ d_r
        return d_l @ p[f"l{k}"].T + d_r @ p[f"r{k}"].T

    def forward(self, x, graph):
        src, dst, w = graph
        n = len(x)
        h1, c1 = self._conv(x, src, dst, w, n, 1, self.heads)
        h2, c2 = self._conv(h1, src, dst, w, n, 2, 1)
        return h2 @ self.p["w"] + self.p["b"], (h2, c1, c2)

    def gradients(self, x, graph, y, mask) -> tuple[float, dict]:
        src, dst, w = graph
        n = len(x)
        pred, (h2, c1, c2) = self.forward(x, graph)
        e = np.where(mask[:, None], pred - y, 0.0)
        size = mask.sum() * y.shape[1]
        g = 2 * e / size
        out = {"w": h2.T @ g, "b": g.sum(0)}
        back = self._back(g @ self.p["w"].T, c2, src, dst, w, n, 2, 1, out)
        self._back(back, c1, src, dst, w, n, 1, self.heads, out)
        return float((e * e).sum() / size), out


def graph_arrays(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
    """Edges with loops as numpy arrays."""
    keep = src != dst
    src, dst, w = src[keep], dst[keep], w[keep]
    total, count = np.bincount(dst, w, n), np.bincount(dst, minlength=n)
    loops = np.arange(n)
    return np.concatenate([src, loops]), np.concatenate([dst, loops]), np.concatenate([w, total / np.maximum(count, 1)])
