"""Weighted graphs as edge tables (src, dst, w)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.expr import dot
from latticework.storage import new_path, written

from . import meet, paths, rank, spatial
from .meet import meetings


def gaussian_edges(nodes: DataFrame, radius: float = 600.0, sigma: float = 200.0, keep: tuple[str, ...] = (), distance: bool = False) -> DataFrame:
    """src, dst, w: exp(-d**2 / (2 sigma**2)) within the radius, rows standardised; src_c and dst_c for each column c of keep, and d if asked for."""
    types = dict(nodes.dtypes)
    names = ["src", "dst", "w", *(f"{end}_{c}" for c in keep for end in ("src", "dst")), *(["d"] if distance else [])]
    kinds = [types["id"], types["id"], "double", *(types[c] for c in keep for _ in range(2)), *(["double"] if distance else [])]

    def weigh(q: pa.Table, row: np.ndarray, m: pa.Table, col: np.ndarray, d: np.ndarray) -> pa.Table:
        other = q.column("id").to_numpy()[row] != m.column("id").to_numpy()[col]
        row, col, d = row[other], col[other], d[other]
        w = np.exp(-d * d / (2 * sigma * sigma))
        total = np.bincount(row, w, q.num_rows)[row]
        ends = [t.column(c).take(at) for c in ("id", *keep) for t, at in ((q, pa.array(row)), (m, pa.array(col)))]
        return pa.table([*ends[:2], pa.array(w / np.where(total == 0, 1.0, total)), *ends[2:], *([pa.array(d)] if distance else [])], names=names)

    at = nodes.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *keep)
    return spatial.around(at, at, radius, weigh, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


#: Pivots of a search, at most, and what is added to an angle's bound, so that similarities that are equal when rounded are all seen.
MOST_PIVOTS, SLACK = 2048, 1e-5
#: Blocks of rows that a heap of cells holds, about: how often a row is sent falls with it, and a task's rows grow.
HEAP_BLOCKS = 4


def _unit(rows) -> np.ndarray:
    m = np.array(rows, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, cells: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """The k best of v for each of q, by rounded similarity, then id; none of the same cell, if cells are given."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(0, len(q), 512):
        sim = np.round(q[i : i + 512] @ v.T, 12)
        sim[q_ids[i : i + 512, None] == ids[None, :]] = -np.inf
        if cells:
            sim[cells[0][i : i + 512, None] == cells[1][None, :]] = -np.inf
        if sim.shape[1] > k:  # the k-th largest of each row; whatever equals it is sorted out by id
            least = np.partition(sim, -k, axis=1)[:, -k]
            row, col = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
        else:
            row, col = np.nonzero(np.isfinite(sim))
        value = sim[row, col]
        order = np.lexsort((ids[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append((q_ids[i + row[keep]], ids[col[keep]], value[keep]))
    src, dst, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table({"src": src, "dst": dst, "sim": s})


_SIMILAR = "src long, dst long, sim double"


def _pivots(vectors: DataFrame, pivots: int | None) -> np.ndarray:
    """Unit vectors: as many as the square root of the table, MOST_PIVOTS at most. Of four times as many rows with the least hashes, each is the one that is farthest from those before it."""
    n = pivots or min(MOST_PIVOTS, max(1, math.isqrt(vectors.count())))
    sample = _unit([r.v for r in rank.hash_sample(vectors, "id", 4 * n).collect()] or [[0.0]])
    chosen, far = [0], _angle(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angle(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v (unit), key (the pivot of least angle), angle: written."""

    def run(batches):
        for b in batches:
            v = _unit(b.column(1).to_pylist()).reshape(b.num_rows, -1)
            far = _angle(v, pivots)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(v)), near])], names=["id", "v", "key", "angle"])

    return written(vectors.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, v array<double>, key int, angle double"), "placed")


def visits(placed: DataFrame, known: DataFrame, pivots: np.ndarray, heap: np.ndarray | None = None) -> DataFrame:
    """id, v, key, home: the cells that can hold one of a row's best, its own cell (home) among them. known: id, least (the k-th best similarity so far, null if there are fewer).
    With heap (a number for each cell): id, v, key, cell (the row's own): the heaps that have such cells beside its own.

    A row's angle to any member of a cell is its angle to the pivot less the cell's radius at least; cells beyond the k-th best angle are skipped.
    """
    radius = np.full(len(pivots), -np.inf)
    for r in placed.groupBy("key").agg(F.max("angle").alias("r")).collect():  # a row for each pivot
        radius[r.key] = r.r

    def run(batches):
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            home, least = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            limit = np.where(np.isnan(least), np.pi, np.arccos(np.clip(np.nan_to_num(least), -1, 1))) + SLACK
            reach = (_angle(v, pivots) - radius <= limit[:, None]) & np.isfinite(radius)
            if heap is not None:
                reach[np.arange(len(v)), home] = False
                reach = np.logical_or.reduceat(reach, first, axis=1)  # cells of a heap follow each other
            row, cell = np.nonzero(reach)
            for k in range(0, len(row), 20_000):
                at = pa.array(row[k : k + 20_000])
                own, to = home[row[k : k + 20_000]], cell[k : k + 20_000]
                key, last = (to, pa.array(to == own)) if heap is None else (heap[first[to]], pa.array(own))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(key.astype(np.int32)), last], names=["id", "v", "key", "home" if heap is None else "cell"])

    first = None if heap is None else np.flatnonzero(np.r_[True, heap[1:] != heap[:-1]])
    return placed.join(known, "id", "left").select("id", "v", "key", "least").mapInArrow(run, f"id long, v array<double>, key int, {'home boolean' if heap is None else 'cell int'}")


def cosine_nearest(vectors: DataFrame, k: int = 8, pivots: int | None = None) -> DataFrame:
    """src, dst, sim, pos: the k most similar others by (similarity, id), self excluded by id. vectors: id, v (array).

    Exact, by pivots: every row belongs to the cell of its nearest pivot. Rows first meet their own cell; the k-th best similarity found there bounds the angle within which better ones lie,
    and by the triangle inequality of angles only cells that reach into it are visited. Cells that follow each other are visited as one heap of about HEAP_BLOCKS blocks of rows, so a row is sent once for
    each heap, not for each cell. They meet block by block, so a cell that holds most rows (copies, say) is more tasks, not a larger one. Where all rows are about equally far from each
    other, no bound helps and all heaps are visited: then a row is sent as often as the table has blocks.
    """
    centres = _pivots(vectors, pivots)
    placed = _placed(vectors, centres)

    def best(q: pa.Table, m: pa.Table) -> pa.Table:
        if not q.num_rows or not m.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        wide = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        cells = (q.column("cell").to_numpy(), m.column("cell").to_numpy()) if "cell" in q.column_names else None
        return _best(q.column("id").to_numpy(), wide(q), m.column("id").to_numpy(), wide(m), k, cells)

    top = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    rows = placed.select("key", "id", "v")
    home = meetings(rows, rows, best, _SIMILAR).withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= k)
    home = written(home, "home")
    known = home.where(F.col("pos") == k).select(F.col("src").alias("id"), F.col("sim").alias("least"))
    size = np.zeros(len(centres), np.int64)
    for r in placed.groupBy("key").agg(F.count("*").alias("n")).collect():  # a row for each pivot
        size[r.key] = r.n
    heap = (np.cumsum(size) - size) // (HEAP_BLOCKS * meet.BLOCK_ROWS)
    in_heap = placed.select(F.col("key").alias("cell"), F.array(*(F.lit(int(h)) for h in heap))[F.col("key")].alias("key"), "id", "v")
    away = meetings(visits(placed, known, centres, heap), in_heap, best, _SIMILAR, HEAP_BLOCKS * meet.BLOCK_ROWS)
    return home.drop("pos").unionByName(away).withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= k)


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """a, b, sim of a stated, small set of vectors."""
    n = F.sqrt(dot(F.col("v"), F.col("v")))
    u = vectors.withColumn("n", n)
    a, b = u.select(*(F.col(c).alias("a_" + c) for c in u.columns)), u.select(*(F.col(c).alias("b_" + c) for c in u.columns))
    return a.join(b, F.col("a_id") != F.col("b_id")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (dot(F.col("a_v"), F.col("b_v")) / F.col("a_n") / F.col("b_n")).alias("sim"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is there too."""
    edges = written(edges, "edges")  # read twice
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_semi")


def merge_edges(*tables: DataFrame) -> DataFrame:
    """Both directions of all edges, the largest weight of each pair (0 at least), no loops; so the result is symmetric, not row-standardised."""
    both = None
    for t in tables:
        for s in (t.select("src", "dst", "w"), t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")):
            both = s if both is None else both.unionByName(s)
    return both.where("src <> dst").groupBy("src", "dst").agg(F.greatest(F.lit(0.0), F.max("w")).alias("w"))


def check_symmetric(edges: DataFrame) -> DataFrame:
    """n_loops, n_not_positive, n_one_way: all 0 for a proper graph."""
    loops = edges.agg(F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("n_loops"), F.sum(F.when(F.col("w") <= 0, 1).otherwise(0)).alias("n_not_positive"))
    e = edges.select("src", "dst")
    one_way = e.exceptAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).agg(F.count("*").alias("n_one_way"))
    return loops.crossJoin(one_way)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def roles(nodes: DataFrame, hub: float = 0.9, low: float = 0.5) -> DataFrame:
    """nodes (with degree) with role: hub from the upper quantile on, peripheral up to the lower one, else normal."""
    from .rank import exact_quantiles

    q = exact_quantiles(nodes, ["degree"], [hub, low]).toDF("__q")
    return nodes.crossJoin(F.broadcast(q)).withColumn("role", F.when(F.col("degree") >= F.col("__q")[0], "hub").when(F.col("degree") <= F.col("__q")[1], "peripheral").otherwise("normal")).drop("__q")


def betweenness(nodes: DataFrame, edges: DataFrame, block: Column | None = None) -> DataFrame:
    """id, betweenness: over unordered pairs of other nodes, the summed share of their shortest paths (by number of edges, in either direction) that pass through.

    With block (a number for each node, alike for near ones; a block has to fit in a task), batches of sources go through blocks (`paths.through`): no pair is written. Without it:

    Breadth-first from all nodes at once: a level is a table (source, node, number of shortest paths), made of the level before by a join with the edges; what is in that level or the one
    before it isn't new. Then dependencies are summed from the last level back. There are as many rows as pairs that reach each other, and two jobs for each step of the longest path.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("src").alias("v"), F.col("dst").alias("to")).where("v <> to")
    kind = edges.schema["src"].dataType.simpleString()
    e = written(e.union(e.select("to", "v")).distinct(), "edges")
    if block is not None:
        summed = paths.through(nodes, e, block).select("id", (F.col("total") / 2).alias("betweenness"))
        return nodes.select("id").join(summed, "id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    start = nodes.select(F.col("id").alias("v")).distinct().join(e.select("v").distinct(), "v", "left_semi")
    levels = [written(start.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")), "level")]
    while True:
        step = levels[-1].join(e, "v").groupBy("s", F.col("to").alias("v")).agg(F.sum("paths").alias("paths"))
        seen = levels[-1].select("s", "v") if len(levels) == 1 else levels[-1].select("s", "v").unionByName(levels[-2].select("s", "v"))
        new = written(step.join(seen, ["s", "v"], "left_anti"), "level")
        if new.isEmpty():
            break
        levels.append(new)
    base = new_path(spark, "dependencies")
    below = levels[-1].withColumn("share", F.lit(0.0))
    for k in range(len(levels) - 1, 0, -1):
        below.select("s", "v", "paths", "share").write.parquet(f"{base}/{k}")
        below = spark.read.schema(f"s {kind}, v {kind}, paths double, share double").parquet(f"{base}/{k}")
        part = below.join(e, "v").groupBy("s", F.col("to").alias("v")).agg(F.sum((1 + F.col("share")) / F.col("paths")).alias("part"))
        below = levels[k - 1].join(part, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share"))
    if len(levels) == 1:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    every = spark.read.schema(f"v {kind}, share double").parquet(*(f"{base}/{k}" for k in range(1, len(levels))))
    summed = every.groupBy(F.col("v").alias("id")).agg((F.sum("share") / 2).alias("betweenness"))
    return nodes.select("id").join(summed, "id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, coefficient: the share of pairs of neighbours that are linked. Triangles are found from the end of lower degree, so hubs aren't squared."""
    d = degrees(nodes.select("id"), edges)
    e = edges.select("src", "dst").where("src <> dst").distinct()
    e = e.join(d.withColumnsRenamed({"id": "src", "degree": "ds"}), "src").join(d.withColumnsRenamed({"id": "dst", "degree": "dd"}), "dst")
    up = e.where("ds < dd OR (ds = dd AND src < dst)").select("src", "dst")
    wedge = up.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(up.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b <> c")
    tri = wedge.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    of = tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    k = F.col("degree")
    return d.join(of, "id", "left").select("id", F.when(k > 1, 2 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("coefficient"))
