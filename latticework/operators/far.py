"""Silhouettes of rows on a line or in a plane: near rows meet one by one, far blocks of rows by interpolated distances, so no two rows far from each other meet."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.storage import removed, written

#: Rows of a block, unless that makes more than BLOCKS of them; blocks of a task; rows of a partition of blocks.
ROWS, BLOCKS, GROUP, PARTITION = 512, 4096, 8, 65_536
#: Boxes are far if their centres are APART times their radii's sum from each other. Then distances interpolated at NODES Chebyshev nodes a side are right to 1e-9 of themselves.
APART, NODES = 2.0, 14
#: Children of a box; bits of a coordinate on the curve that orders rows.
CHILDREN, BITS = 4, 31

_AT = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
_TERMS = np.cos(np.arange(NODES)[None] * _AT[:, None]) * np.where(np.arange(NODES) == 0, 1, 2) / NODES


def _scale(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (lo + hi) / 2, (hi - lo) / 2


def nodes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The nodes of a box."""
    mid, half = _scale(lo, hi)
    u, v = np.meshgrid(np.cos(_AT), np.cos(_AT), indexing="ij")
    return mid + half * np.column_stack([u.ravel(), v.ravel()])


def shares(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each row of x its interpolation from the box's nodes."""
    mid, half = _scale(lo, hi)
    angle = np.arccos(np.clip((x - mid) / np.where(half > 0, half, 1), -1, 1))
    u, v = (np.cos(angle[:, k, None] * np.arange(NODES)) @ _TERMS.T for k in (0, 1))
    return (u[:, :, None] * v[:, None]).reshape(len(x), -1)


def curve(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places on a Hilbert curve through the box."""
    last = (1 << BITS) - 1
    a, b = ((x - lo) / np.where(hi > lo, hi - lo, 1) * last).astype(np.int64).T
    out = np.zeros(len(x), np.int64)
    for k in range(BITS - 1, -1, -1):
        ra, rb = a >> k & 1, b >> k & 1
        out += (3 * ra ^ rb) << (2 * k)
        turn, flip = rb == 0, (rb == 0) & (ra == 1)
        a, b = np.where(flip, last - a, a), np.where(flip, last - b, b)
        a, b = np.where(turn, b, a), np.where(turn, a, b)
    return out


@dataclass
class Tree:
    """Boxes: blocks of rows first, then boxes of CHILDREN boxes of the same label. weights: what a box's rows come to at its nodes."""

    lo: np.ndarray
    hi: np.ndarray
    weights: np.ndarray
    label: np.ndarray
    first: np.ndarray
    last: np.ndarray
    roots: np.ndarray
    blocks: int

    def far(self, lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which boxes of these are far from a box."""
        (mid, half), (m, h) = _scale(lo, hi), _scale(self.lo[of], self.hi[of])
        return np.hypot(*(m - mid).T) >= APART * (np.hypot(*half) + np.hypot(*h.T))

    def met(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest far boxes and the near blocks, which hold every row once."""
        far, near, now = [], [], self.roots
        while len(now):
            away = self.far(lo, hi, now)
            far.append(now[away])
            now = now[~away]
            near.append(now[now < self.blocks])
            inner = now[now >= self.blocks]
            now = np.concatenate([np.arange(a, b) for a, b in zip(self.first[inner], self.last[inner], strict=True)]) if len(inner) else inner
        return np.concatenate(far), np.concatenate(near)


def tree(lo: np.ndarray, hi: np.ndarray, weights: np.ndarray, label: np.ndarray) -> Tree:
    """Of blocks by label, in the curve's order."""
    low, high, weight, of, first, last, roots = list(lo), list(hi), list(weights), label.tolist(), [0] * len(lo), [0] * len(lo), []
    for l in np.unique(label):
        level = np.flatnonzero(label == l).tolist()
        while len(level) > 1:
            above = []
            for k in range(0, len(level), CHILDREN):
                part = level[k : k + CHILDREN]
                a, b = np.min([low[i] for i in part], 0), np.max([high[i] for i in part], 0)
                above.append(len(low))
                low.append(a), high.append(b), of.append(int(l)), first.append(part[0]), last.append(part[-1] + 1)
                weight.append(sum(shares(nodes(low[i], high[i]), a, b).T @ weight[i] for i in part))
            level = above
        roots += level
    return Tree(*(np.array(v) for v in (low, high, weight, of, first, last, roots)), len(lo))


def pairs(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each row of x the sum of its distances from the rows of y, each counted so many times."""
    out, d, e = np.empty(len(x)), np.empty((64, len(y))), np.empty((64, len(y)))
    for i in range(0, len(x), 64):
        n = len(x[i : i + 64])
        np.subtract.outer(x[i : i + n, 0], y[:, 0], out=d[:n])
        np.subtract.outer(x[i : i + n, 1], y[:, 1], out=e[:n])
        np.multiply(d[:n], d[:n], out=d[:n])
        np.multiply(e[:n], e[:n], out=e[:n])
        np.add(d[:n], e[:n], out=d[:n])
        out[i : i + n] = np.sqrt(d[:n], out=d[:n]) @ many
    return out


def sums(t: Tree, x: np.ndarray, blocks: dict[int, tuple[np.ndarray, np.ndarray]], labels: int) -> np.ndarray:
    """For each row of x the sum of its distances from all rows of each label. blocks: rows and counts of the blocks near x."""
    lo, hi = x.min(0), x.max(0)
    far, near = t.met(lo, hi)
    at, mid = nodes(lo, hi), (lo + hi) / 2
    p = at - mid
    p = np.column_stack([p, (p * p).sum(1), np.ones(len(p))])
    smooth = np.zeros((len(at), labels))
    for k in far:
        q = nodes(t.lo[k], t.hi[k]) - mid
        d = p @ np.column_stack([-2 * q, np.ones(len(q)), (q * q).sum(1)]).T
        smooth[:, t.label[k]] += np.sqrt(np.maximum(d, 0, out=d), out=d) @ t.weights[k]
    out = shares(x, lo, hi) @ smooth
    for k in near:
        out[:, t.label[k]] += pairs(x, *blocks[int(k)])
    return out


def _plane(v: pa.Array, size: int) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), size)
    return x if size == 2 else np.column_stack([x, np.zeros(len(x))])


def _packed(points: DataFrame, size: int, lo: np.ndarray, hi: np.ndarray, rows: int, total: int) -> DataFrame:
    """Blocks of rows of a label that follow each other on the curve, written: label, place, bounds, weights, rows and their counts."""

    def placed(batches):
        for b in batches:
            h = curve(_plane(b.column(1), size), lo, hi) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h)], names=["l", "v", "c", "h"])

    def pack(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        part, t = TaskContext.get().partitionId(), pa.Table.from_batches(got).combine_chunks()
        l, x, c = np.array(t.column("l").to_pylist(), object), _plane(t.column("v").chunk(0), size), t.column("c").to_numpy().astype(float)
        begins = np.flatnonzero(np.r_[True, l[1:] != l[:-1]])
        out = []
        for a, b in zip(begins, [*begins[1:], len(l)], strict=True):
            for i in range(a, b, rows):
                p, many = x[i : min(b, i + rows)], c[i : min(b, i + rows)]
                low, high = p.min(0), p.max(0)
                out.append((l[a], part, len(out), low.tolist(), high.tolist(), (shares(p, low, high).T @ many).tobytes(), p.tobytes(), many.tobytes()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["l", "part", "seq", "lo", "hi", "w", "x", "c"])

    at = points.select("l", "v", "c").mapInArrow(placed, "l string, v array<double>, c long, h long")
    at = at.repartitionByRange(max(1, -(-total // PARTITION)), "l", "h").sortWithinPartitions("l", "h")
    return written(at.mapInArrow(pack, "l string, part int, seq int, lo array<double>, hi array<double>, w binary, x binary, c binary"), "packed")


def silhouettes(points: DataFrame, size: int, lo: list[float], hi: list[float], total: int) -> DataFrame:
    """l, v, c, silhouette, written. points: l, v (size numbers, one or two, all finite, different within a label) and c, how many rows each stands for; lo, hi: bounds; total: points.

    Rows go in blocks along a Hilbert curve. The driver gets a block's bounds and what its rows come to at the nodes of an interpolation, for BLOCKS blocks and one more for each label and
    partition at most. A task takes GROUP blocks and the rows of blocks near them; far blocks, joined to larger boxes the further they are, are met by their nodes only. All rows count:
    what interpolation leaves is 1e-9 of a distance at most, and far less of a sum.
    """
    lo, hi = (np.array([*v, 0.0][:2]) for v in (lo, hi))
    packs = _packed(points, size, lo, hi, max(ROWS, -(-total // BLOCKS)), total)
    found = sorted(packs.select("l", "part", "seq", "lo", "hi", "w").collect(), key=lambda r: (r.l, r.part, r.seq))
    names = sorted({r.l for r in found})
    t = tree(*(np.array(v) for v in ([r.lo for r in found], [r.hi for r in found], [np.frombuffer(r.w) for r in found], [names.index(r.l) for r in found])))
    every = np.arange(t.blocks)
    n = np.bincount(t.label[t.roots], t.weights[t.roots].sum(1), len(names)).round()
    group, need = every // GROUP, []
    for g in range(group[-1] + 1):
        near = np.zeros(t.blocks, bool)
        for k in every[group == g]:
            near |= ~t.far(t.lo[k], t.hi[k], every)
        need += [(g, int(k)) for k in np.flatnonzero(near)]
    spark = points.sparkSession
    index = F.broadcast(spark.createDataFrame(pa.table({"part": pa.array([r.part for r in found], pa.int32()), "seq": pa.array([r.seq for r in found], pa.int32()), "b": every, "g": group})))
    wanted = F.broadcast(spark.createDataFrame(pa.table({"g": pa.array([g for g, _ in need], pa.int64()), "b": pa.array([k for _, k in need], pa.int64())})))
    rows = packs.select("part", "seq", "x", "c").join(index, ["part", "seq"]).select("g", "b", "x", "c")
    tasks = int(min(512, group[-1] + 1))

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        read = lambda a: {k: (np.frombuffer(x.as_py()).reshape(-1, 2), np.frombuffer(c.as_py())) for k, x, c in zip(a.column("b").to_pylist(), a.column("x"), a.column("c"), strict=True)}
        blocks, out = read(near), []
        for k, (x, c) in sorted(read(own).items()):
            s, l = sums(t, x, blocks, len(names)), t.label[k]
            a = s[:, l] / max(n[l] - 1, 1)
            b = np.where(np.arange(len(names)) == l, np.inf, s / n).min(1)
            top = np.maximum(a, b)
            found = np.divide(b - a, top, out=np.zeros(len(x)), where=(top > 0) & np.isfinite(b)) if n[l] > 1 else np.zeros(len(x))
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x[:, :size].ravel()))
            out.append(pa.table({"l": pa.array([names[l]] * len(x)), "v": v, "c": c.astype(np.int64), "silhouette": found}))
        return pa.concat_tables(out)

    other = rows.select(*(F.col(c).alias(c) for c in ("b", "x", "c")))  # both sides are one table
    near = other.join(wanted, "b").select(F.col("g").alias("at"), "b", "x", "c").repartition(tasks, "at")
    met = rows.repartition(tasks, "g").groupBy("g").cogroup(near.groupBy("at")).applyInArrow(run, "l string, v array<double>, c long, silhouette double")
    out = written(met, "silhouettes", clean=True)
    removed(packs)
    return out
