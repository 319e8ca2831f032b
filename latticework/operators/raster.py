"""Pixels as rows (row, col, value) and windows of cells over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(cells: DataFrame, pixels: DataFrame, side: int) -> DataFrame:
    """id and pixel columns for each cell's window (id, r0, c0), side x side pixels; windows may overlap. An equi-join on tiles of that side, then the exact test."""
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    spot = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    w = cells.select("id", "r0", "c0", F.explode(spot).alias("s")).select("id", "r0", "c0", (tile("r0") + F.col("s.i")).alias("__tr"), (tile("c0") + F.col("s.j")).alias("__tc"))
    p = pixels.withColumns({"__tr": tile("row"), "__tc": tile("col")})
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r0") + side) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c0") + side)
    return w.join(p, ["__tr", "__tc"]).where(inside).drop("__tr", "__tc")


def zonal_mean(cells: DataFrame, pixels: DataFrame, side: int) -> DataFrame:
    """id, mean of the window's values that aren't null; null without any."""
    m = windows(cells, pixels, side).groupBy("id").agg(F.avg("value").alias("mean"))
    return cells.select("id").join(m, "id", "left")


def shannon_diversity(win: DataFrame) -> DataFrame:
    """id, shdi: Shannon diversity of classes over pixels whose class isn't 0."""
    from .stats import shannon

    return shannon(win.where("value <> 0"), ["id"], "value").select("id", F.col("entropy").alias("shdi"))


def least_perimeter(area: Column) -> Column:
    """Perimeter of the most compact shape of so many pixels."""
    n = F.floor(F.sqrt(area.cast("double"))).cast("long")
    return F.when(area == n * n, 4 * n).when(area <= n * (n + 1), 4 * n + 2).otherwise(4 * n + 4)


def landscape_shape(win: DataFrame) -> DataFrame:
    """id, lsi: edges between classes, and between them and what is outside, over the least perimeter. Each pixel counts the sides on which its right and lower neighbour differ, so an
    inner edge counts once.
    """
    v = win.where("value <> 0").select("id", "row", "col", "value")
    sides = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    out = v.select("id", "value", F.explode(sides).alias("s"), "row", "col").select("id", "value", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    met = out.join(v.withColumnRenamed("value", "other"), ["id", "row", "col"], "left")
    edges = met.groupBy("id").agg((F.sum(F.when(F.col("other").isNull(), 2).when(F.col("other") != F.col("value"), 1).otherwise(0)) / 2).alias("edge"), (F.count("*") / 4).cast("long").alias("area"))
    return edges.select("id", (F.col("edge") / least_perimeter(F.col("area"))).alias("lsi"))


def patches(grid: np.ndarray) -> np.ndarray:
    """Numbers the 8-connected patches of equal values (from 1; 0 where the value is 0), by spreading the least number until nothing changes."""
    h, w = grid.shape
    label = np.where(grid != 0, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        new = label.copy()
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                a = (slice(max(0, dr), h + min(0, dr)), slice(max(0, dc), w + min(0, dc)))
                b = (slice(max(0, -dr), h + min(0, -dr)), slice(max(0, -dc), w + min(0, -dc)))
                same = (grid[a] == grid[b]) & (grid[a] != 0)
                new[a] = np.where(same, np.minimum(new[a], new[b]), new[a])
        if (new == label).all():
            return label
        label = new


def patch_metrics(grid: np.ndarray, least: int = 4) -> tuple[float | None, float | None]:
    """Largest patch (% of the pixels that aren't 0), and the nearest-neighbour distance: for classes of two patches at least, each patch's least centre distance to another
    of its class less one pixel, weighted by area; 0 without such a class. Both null below `least` pixels.
    """
    n = int((grid != 0).sum())
    if n < least:
        return None, None if n == 0 else 0.0
    label = patches(grid)
    number, size = np.unique(label[label > 0], return_counts=True)
    total = weight = 0.0
    at = {k: np.argwhere(label == k) for k in number}
    kind = {k: grid[tuple(at[k][0])] for k in number}
    for k, area in zip(number, size, strict=True):
        others = [at[j] for j in number if j != k and kind[j] == kind[k]]
        if others:
            o = np.concatenate(others)
            d = np.sqrt(((at[k][:, None, :] - o[None, :, :]) ** 2).sum(2)).min() - 1
            total += max(0.0, d) * area
            weight += area
    return 100.0 * size.max() / n, total / weight if weight else 0.0


def patch_statistics(win: DataFrame, side: int) -> DataFrame:
    """id, lpi, menn. A window is a group of side x side pixels at most, which numpy labels."""

    def run(t: pa.Table) -> pa.Table:
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        grid = np.zeros((side, side), np.int64)
        grid[r - r.min(), c - c.min()] = np.nan_to_num(t.column("value").to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        lpi, menn = patch_metrics(grid)
        return pa.table({"id": t.column("id").slice(0, 1), "lpi": pa.array([lpi], pa.float64()), "menn": pa.array([menn], pa.float64())})

    return win.select("id", "row", "col", "value").groupBy("id").applyInArrow(run, "id long, lpi double, menn double")


def rasterise(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """pixels with value: the class of the box (x0, y0, x1, y1, value, seq) that holds the pixel's centre, the last by seq if there are several, else 0."""
    size = 64.0
    b = boxes.withColumns({"__bx": F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))}).withColumn("__by", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    p = pixels.select("row", "col").withColumns({"px": F.col("col") + 0.5, "py": F.col("row") + 0.5}).withColumns({"__bx": F.floor(F.col("px") / size), "__by": F.floor(F.col("py") / size)})
    hit = p.join(b, ["__bx", "__by"]).where("px >= x0 AND px < x1 AND py >= y0 AND py < y1").groupBy("row", "col").agg(F.max_by("value", "seq").alias("value"))
    return pixels.select("row", "col").join(hit, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
