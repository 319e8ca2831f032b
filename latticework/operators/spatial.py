"""Joins in the plane. Distances are Euclidean; every distance join is an equi-join on square bins with the exact test afterwards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.storage import written

from .meet import meetings


def _binned(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({"__bx": F.floor(F.col("x") / size).cast("long"), "__by": F.floor(F.col("y") / size).cast("long")})


def _neighbourhood(df: DataFrame, size: float, reach: int = 1) -> DataFrame:
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    return _binned(df, size).withColumn("__s", F.explode(step)).withColumns({"__bx": F.col("__bx") + F.col("__s.i"), "__by": F.col("__by") + F.col("__s.j")}).drop("__s")


def _as(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("__bx", "__by")) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """a_*, b_* and d for all pairs (id, x, y on both sides) at most `radius` apart. The left side is small (it is written out nine times)."""
    pairs = _as(_neighbourhood(left, radius), "a_").join(_as(_binned(right, radius), "b_"), ["__bx", "__by"]).drop("__bx", "__by")
    return pairs.withColumn("d", F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), F.lit(2.0)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2.0)))).where(F.col("d") <= radius)


def radius_edges(nodes: DataFrame, radius: float) -> DataFrame:
    """src, dst, d: all ordered pairs of different nodes."""
    return radius_join(nodes.select("id", "x", "y"), nodes.select("id", "x", "y"), radius).where("a_id <> b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d")


#: Sides of a square that rows meet in, in radii, and the queries of a block of it.
SQUARE, QUERIES = 4, 1024


def around(left: DataFrame, right: DataFrame, radius: float, meet: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, whole: bool = True) -> DataFrame:
    """What meet(q, row, m, col, d) gives for blocks of left rows q and the right rows m (both with id, x, y) near them: q[row] and m[col] are d apart, `radius` at most, by row.

    Squares of SQUARE radii: a left row is in its own one, a right row in all that its radius touches (four at most). So all that is near a left row comes to it at once (unless not whole: then
    block by block), and no task sorts or holds pairs, only rows; pairs exist while a block of QUERIES rows meets.
    """
    side, reach = SQUARE * radius, radius * (1 + 1e-9)  # so that no rounding hides what is just within the radius
    key = lambda x, y: F.struct(x.cast("long").alias("bx"), y.cast("long").alias("by"))
    bin_ = lambda c, by: F.floor((F.col(c) + by) / side)
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    q = left.where(there).select("*", key(bin_("x", 0.0), bin_("y", 0.0)).alias("key"))
    touched = F.array_distinct(F.array(*(key(bin_("x", i * reach), bin_("y", j * reach)) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    m = right.where(there).select("*", F.explode(touched).alias("key"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        xy = [[t.column(c).to_numpy() for c in ("x", "y")] for t in (a, b)]
        step, rows, cols, ds = max(1, 4_000_000 // max(1, b.num_rows)), [], [], []
        for i in range(0, a.num_rows, step):
            d = np.sqrt((xy[0][0][i : i + step, None] - xy[1][0]) ** 2 + (xy[0][1][i : i + step, None] - xy[1][1]) ** 2)
            row, col = np.nonzero(d <= radius)
            rows.append(row + i)
            cols.append(col)
            ds.append(d[row, col])
        none = np.empty(0, np.int64)
        return meet(a, np.concatenate([none, *rows]), b, np.concatenate([none, *cols]), np.concatenate([np.empty(0), *ds]))

    return meetings(q, m, near, schema, QUERIES if whole else None, whole)


def kinds_around(left: DataFrame, right: DataFrame, radius: float, kind: str) -> DataFrame:
    """id, n, kinds: how many right rows are within the radius of a left row, and how many different values of `kind` they have (nulls aren't one). Left rows with nothing near are left out."""

    def count(q: pa.Table, row: np.ndarray, m: pa.Table, col: np.ndarray, _) -> pa.Table:
        code = m.column("kind").combine_chunks().dictionary_encode(null_encoding="encode")
        names, at = code.dictionary, code.indices.to_numpy()
        n = np.bincount(row * len(names) + at[col], minlength=q.num_rows * len(names))
        some = np.flatnonzero(n)
        return pa.table([q.column("id").take(pa.array(some // max(1, len(names)))), names.take(pa.array(some % max(1, len(names)))), pa.array(n[some])], names=["id", "kind", "n"])

    at = lambda df, *more: df.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *more)
    types = dict(right.dtypes)
    parts = around(at(left), at(right, F.col(kind).alias("kind")), radius, count, f"id {dict(left.dtypes)['id']}, kind {types[kind]}, n long", whole=False)
    return parts.groupBy("id", "kind").agg(F.sum("n").alias("n")).groupBy("id").agg(F.sum("n").alias("n"), F.count("kind").alias("kinds"))


def point_in_cell(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """points with cell: the id of the square of side `size`, centred at a cell's x, y, that holds the point (left and lower edges inside), else null."""
    key = lambda c, s: F.floor((F.col(c) + s) / size).cast("long")
    grid = cells.select(F.col("id").alias("cell"), key("x", 0.0).alias("__gx"), key("y", 0.0).alias("__gy"))
    return points.withColumns({"__gx": key("x", 0.0), "__gy": key("y", 0.0)}).join(grid, ["__gx", "__gy"], "left").drop("__gx", "__gy")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """point, polygon: each point (id, x, y) with each polygon (id, ring: closed array of (x, y), in either direction) that holds it, by the parity of sides crossed to the right.

    Polygons are written out for the bins of `size` that their bounding box touches; choose it near the polygons' size.
    """
    bin_ = lambda c: F.floor(c / size).cast("long")
    reach = lambda c: F.explode(F.sequence(bin_(F.array_min(F.transform("ring", lambda p: p[c]))), bin_(F.array_max(F.transform("ring", lambda p: p[c])))))
    polys = polygons.where(F.size("ring") > 2).select(F.col("id").alias("polygon"), "ring").withColumn("__bx", reach("x")).withColumn("__by", reach("y"))
    pts = _binned(points.select(F.col("id").alias("point"), "x", "y"), size)
    x, y = F.col("x"), F.col("y")
    crosses = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])
    sides = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda p, q: F.coalesce(crosses(p, q), F.lit(False)))
    return pts.join(polys, ["__bx", "__by"]).where(F.size(F.filter(sides, lambda s: s)) % 2 == 1).select("point", "polygon")


def rook_edges(cells: DataFrame) -> DataFrame:
    """src, dst: cells (id, cx, cy) that share a side."""
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    out = cells.select(F.col("id").alias("src"), "cx", "cy", F.explode(step).alias("s")).select("src", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    return out.join(cells.select(F.col("id").alias("dst"), "cx", "cy"), ["cx", "cy"]).select("src", "dst")


def polygon_contiguity(rings: DataFrame) -> DataFrame:
    """src, dst of polygons (id, ring: array of (x, y), closed) that share a whole boundary segment."""
    n = F.size("ring")
    segment = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array_sort(F.array(F.col("ring")[i], F.col("ring")[i + 1])))
    s = rings.where(n > 1).select("id", F.explode(segment).alias("seg"))
    return s.select(F.col("id").alias("src"), "seg").join(s.select(F.col("id").alias("dst"), "seg"), "seg").where("src <> dst").select("src", "dst").distinct()


def nearest(nodes: DataFrame, k: int, size: float) -> DataFrame:
    """src, dst, d, pos: the k nearest others of each node, by (distance, id), exact for any layout.

    Rings of bins are searched outwards; a node is done when it has k others within the distance that its ring fully covers. Nodes that are left
    when the rings reach across the whole layout take what there is. Rounds are written, so that none is worked out again for the next.
    """
    base = nodes.select("id", "x", "y")
    ends = base.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    k = min(k, max(0, ends[4] - 1))
    across = max(ends[1] - ends[0], ends[3] - ends[2]) if ends[4] else 0.0
    left, out, side = base, None, size
    while True:
        got = radius_join(left, base, side).where("a_id <> b_id")
        ranked = got.withColumn("pos", F.row_number().over(Window.partitionBy("a_id").orderBy("d", "b_id"))).where(F.col("pos") <= k).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d", "pos")
        last = side > across * 1.5
        ranked = ranked if last else written(ranked, "nearest")
        full = ranked if last else ranked.join(ranked.where(F.col("pos") == k).select("src"), "src", "left_semi")
        out = full if out is None else out.unionByName(full)
        if last or k == 0:
            return out
        left = written(left.join(ranked.where(F.col("pos") == k).select(F.col("src").alias("id")), "id", "left_anti"), "left")
        if left.isEmpty():
            return out
        side *= 2


def coarse_means(cells: DataFrame, cols: list[str], size: float, least: int = 1) -> DataFrame:
    """key, n and the columns' means of coarse squares counted from the least x and y."""
    from latticework.functions.expr import grid_key

    ends = cells.agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"))
    keyed = cells.crossJoin(F.broadcast(ends)).withColumn("key", grid_key(F.col("x"), F.col("y"), F.col("__x0"), F.col("__y0"), size))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in cols)).where(F.col("n") >= least)
