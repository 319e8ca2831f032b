"""Clusters: k-means archetypes, their names, and validity indices of given labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.expr import arithmetic_hash
from latticework.storage import written

from . import far
from .meet import meetings


def hashed_starts(df: DataFrame, features: list[str], k: int, starts: int, key: str = "id") -> list[np.ndarray]:
    """For each start the features of k rows, those with the least hashes of their key; every start has a hash of its own. All starts are aggregates of one pass."""
    order = lambda s: F.struct(arithmetic_hash(F.col(key), b=11 + 7919 * s).alias("h"), F.col(key).alias("key"), *(F.col(f).cast("double").alias(f) for f in features))
    at = df.dropna(subset=features)
    per = [at.select(F.lit(s).alias("s"), order(s).alias("o")).orderBy("o").limit(k) for s in range(starts)]
    found: dict[int, list] = {s: [] for s in range(starts)}
    for r in reduce(lambda x, y: x.unionByName(y), per).collect():  # starts times k rows
        found[r.s].append((r.o["h"], r.o["key"], [r.o[f] for f in features]))
    return [np.array([v for _, _, v in sorted(rows)], float) for rows in found.values()]


def _to_centres(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, feature by feature, rounded so that equal ones tie."""
    d = np.zeros((len(x), len(c)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - c[None, :, f]) ** 2
    return np.round(d, 9)


def lloyd(df: DataFrame, features: list[str], centres: list[np.ndarray], steps: int = 100) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centres: where they rest (or are after `steps`), the rows that are nearest to each, and the sum of squared distances to the nearest.

    Each step is one aggregate over df for all sets together: tasks sum their rows' features by set and nearest centre, so what leaves a task is a row for each centre. A centre without rows
    stays where it is; the first of equally near centres takes a row. Rows with a missing feature are left out. An unbounded df should be written first, since each step reads it.
    """
    now, size = [np.round(np.asarray(c, float), 9) for c in centres], len(features)
    base = df.select(*(F.col(f).cast("double").alias(f) for f in features)).dropna()

    def totals(sets: list[np.ndarray]) -> list[np.ndarray]:
        """For each set and centre: rows, squared distances, sums of features."""

        def sums(batches):
            out = [np.zeros((len(c), size + 2)) for c in sets]
            for b in batches:
                x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns])
                for c, t in zip(sets, out, strict=True):
                    d = _to_centres(x, c)
                    near = d.argmin(1)
                    t[:, 0] += np.bincount(near, minlength=len(c))
                    t[:, 1] += np.bincount(near, d[np.arange(len(x)), near], minlength=len(c))
                    for f in range(size):
                        t[:, 2 + f] += np.bincount(near, x[:, f], minlength=len(c))
            rows = [(k, j, v) for k, t in enumerate(out) for j, v in enumerate(t.tolist()) if v[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["at", "centre", "v"])

        parts = base.mapInArrow(sums, "at int, centre int, v array<double>")
        got = [np.zeros((len(c), size + 2)) for c in sets]
        for r in parts.groupBy("at", "centre").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(size + 2))).alias("v")).collect():
            got[r.at][r.centre] = r.v
        return got

    moving, at = list(range(len(now))), [None] * len(now)
    for _ in range(steps):
        if not moving:
            break
        for k, t in zip(moving, totals([now[k] for k in moving]), strict=True):
            new = np.where(t[:, :1] > 0, np.round(t[:, 2:] / np.maximum(t[:, :1], 1), 9), now[k])
            at[k] = t if np.array_equal(new, now[k]) else None
            now[k] = new
        moving = [k for k in moving if at[k] is None]
    for k, t in zip(moving, totals([now[k] for k in moving]) if moving else [], strict=True):
        at[k] = t
    return [(c, t[:, 0].astype(np.int64), float(t[:, 1].sum())) for c, t in zip(now, at, strict=True)]


def nearest_centre(features: list[str], centres: np.ndarray) -> Column:
    """The number of the nearest centre, the first of equal ones."""
    d = lambda c: reduce(lambda a, b: a + b, ((F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, c, strict=True)))
    return F.array_min(F.array(*(F.struct(F.round(d(c), 9).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres))))["j"]


def kmeans_of(df: DataFrame, features: list[str], ks: list[int], starts: int = 20, steps: int = 100, key: str = "id") -> dict[int, np.ndarray]:
    """For each number of clusters the centres of its best start (the least sum of squared distances, to six places, the first on ties)."""
    begun = {k: hashed_starts(df, features, k, starts, key) for k in ks}
    ended = lloyd(df, features, [c for k in ks for c in begun[k]], steps)
    out = {}
    for i, k in enumerate(ks):
        mine = ended[i * starts : (i + 1) * starts]
        out[k] = min(mine, key=lambda e: round(e[2], 6))[0]
    return out


def kmeans(df: DataFrame, features: list[str], k: int, starts: int = 20, steps: int = 100, key: str = "id") -> DataFrame:
    """df with cluster: Lloyd's steps from several hashed starts, the best by squared distances."""
    return df.withColumn("cluster", nearest_centre(features, kmeans_of(df, features, [k], starts, steps, key)[k]))


def name_archetypes(df: DataFrame, stress: str, vitality: str, names: tuple[str, str, str] = ("vital", "calm", "balanced")) -> DataFrame:
    """df with archetype: the cluster of most vitality, that of least stress among the others, and the rest."""
    c = df.groupBy("cluster").agg(F.avg(stress).alias("s"), F.avg(vitality).alias("v"))
    top = c.agg(F.max_by("cluster", F.struct("v", -F.col("cluster"))).alias("top"))
    rest = c.crossJoin(F.broadcast(top))
    low = rest.where("cluster <> top").agg(F.min_by("cluster", F.struct("s", "cluster")).alias("low"))
    named = rest.crossJoin(F.broadcast(low)).select("cluster", F.when(F.col("cluster") == F.col("top"), names[0]).when(F.col("cluster") == F.col("low"), names[1]).otherwise(names[2]).alias("archetype"))
    return df.join(F.broadcast(named), "cluster")


def _d2(cols: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.pow(F.col(a + c) - F.col(b + c), F.lit(2.0)) for c in cols))


#: Cells of a label whose bounds are used, at most.
CELLS = 16


def _bounds(base: DataFrame, cells: int) -> list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each label its rows, and its cells' shares, centres and mean squared distances from these. A cell is what is nearest to one of the label's rows with the least hashes."""
    order = Window.partitionBy("l").orderBy(arithmetic_hash(F.col("id")), "id")
    seeds: dict[str, list] = {}
    for r in base.select("id", "l", "v", F.row_number().over(order).alias("k")).where(F.col("k") <= cells).collect():  # CELLS rows for each label
        seeds.setdefault(r.l, []).append(r.v)
    centres = {l: np.array(v, float) for l, v in seeds.items()}
    size = len(next(iter(centres.values()))[0]) if centres else 0

    def sums(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            labels, x = np.array(b.column(0).to_pylist()), np.array(b.column(1).to_pylist(), float)
            for l in np.unique(labels):
                own = x[labels == l]
                cell = _to_centres(own, centres[str(l)]).argmin(1)
                for c in np.unique(cell):
                    p = own[cell == c]
                    total[str(l), int(c)] = total.get((str(l), int(c)), 0) + np.r_[len(p), (p * p).sum(), p.sum(0)]
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["l", "cell", "v"])

    parts = base.select("l", "v").mapInArrow(sums, "l string, cell int, v array<double>")
    found: dict[str, list] = {}
    for r in parts.groupBy("l", "cell").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(size + 2))).alias("v")).collect():
        found.setdefault(r.l, []).append(r.v)
    out = []
    for l, rows in sorted(found.items()):
        t = np.array(rows)
        c = t[:, 2:] / t[:, :1]
        out.append((l, int(t[:, 0].sum()), t[:, 0] / t[:, 0].sum(), c, np.maximum(t[:, 1] / t[:, 0] - (c * c).sum(1), 0)))
    return out


def open_labels(df: DataFrame, features: list[str], label: str, cells: int = CELLS, points: DataFrame | None = None) -> DataFrame:
    """id, v, own, key, n: a row for its own label, and for each other one whose mean distance may be the least (n: the label's rows).

    A row's mean distance from a cell is at least its distance from the cell's centre, and at most the root of its mean squared distance, which the centre and the cell's spread give; the
    cells' shares add both up to bounds for the label. Labels whose lower bound is above another's upper bound can't be the least. points: the rows (id, l, v) to judge, if not all of df.
    """
    base = df.select("id", F.col(label).cast("string").alias("l"), F.array(*(F.col(c).cast("double") for c in features)).alias("v"))
    bounds = _bounds(base, cells)

    def run(batches):
        for b in batches:
            x, own = np.array(b.column(2).to_pylist(), float).reshape(b.num_rows, -1), np.array(b.column(1).to_pylist())
            low, high = np.empty((len(x), len(bounds))), np.empty((len(x), len(bounds)))
            for k, (_, _, share, c, spread) in enumerate(bounds):
                d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
                low[:, k], high[:, k] = np.sqrt(d) @ share, np.sqrt(d + spread) @ share
            mine = own[:, None] == np.array([l for l, *_ in bounds])
            least = np.where(mine, np.inf, high).min(1)
            row, at = np.nonzero(mine | (low <= least[:, None] * (1 + 1e-6) + 1e-6))
            for k in range(0, len(row), 20_000):
                r, t = pa.array(row[k : k + 20_000]), at[k : k + 20_000]
                columns = [b.column(0).take(r), b.column(2).take(r), b.column(1).take(r), pa.array([bounds[i][0] for i in t]), pa.array([bounds[i][1] for i in t], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "own", "key", "n"])

    return (base if points is None else points).select("id", "l", "v").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, v array<double>, own string, key string, n long")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a tile: a matrix product, and feature by feature where rows are so near that it would lose digits (or there are few features)."""
    size = a.shape[1]
    if size > 8:
        norm = (a * a).sum(1)[:, None] + (b * b).sum(1)
        d = norm - 2 * (a @ b.T)
        i, j = np.nonzero(~(d > 1e-3 * norm))
        if len(i) <= d.size // 8:
            d[i, j] = 0
            for f in range(size):
                d[i, j] += (a[i, f] - b[j, f]) ** 2
            return d
    d = np.zeros((len(a), len(b)))
    for f in range(size):
        d += (a[:, f, None] - b[None, :, f]) ** 2
    return d


#: In a plane, labels of more different rows are met by blocks (`far`), unless there are more than LABELS.
FEW, LABELS = 8192, 256


def _silhouettes(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """id, l, v of all rows, and l, v, c (how many), silhouette of the different ones."""
    base = df.select("id", F.col(label).cast("string").alias("l"), F.array(*(F.col(c).cast("double") for c in features)).alias("v"))
    points = written(base.groupBy("l", "v").agg(F.min("id").alias("id"), F.count("*").alias("c")), "points")
    if len(features) <= 2:
        at = [F.col("v")[k] for k in range(len(features))]
        good = reduce(lambda a, b: a & b, (F.coalesce(F.abs(a) < 1e150, F.lit(False)) for a in at)) & F.col("l").isNotNull()
        seen = points.agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("good"), F.countDistinct("l").alias("labels"), F.array(*map(F.min, at)).alias("lo"), F.array(*map(F.max, at)).alias("hi")).first()
        if seen.n > FEW and seen.good == seen.n and seen.labels <= LABELS:
            return base, far.silhouettes(points, len(features), seen.lo, seen.hi, seen.n)
    rows = open_labels(df, features, label, points=points)
    kind = df.schema["id"].dataType.simpleString()

    def sums(q: pa.Table, m: pa.Table) -> pa.Table:
        a, b = (np.array(t.column("v").to_pylist(), float).reshape(t.num_rows, -1) for t in (q, m))
        many = m.column("c").to_numpy().astype(float)
        total = np.zeros(len(a))
        for i in range(0, len(a), 256):
            for j in range(0, len(b), 1024):
                total[i : i + 256] += np.sqrt(_squared(a[i : i + 256], b[j : j + 1024])) @ many[j : j + 1024]
        return q.select(["id", "own", "key", "n"]).append_column("s", pa.array(total))

    members = points.select(F.col("l").alias("key"), "id", "v", "c")
    per = meetings(rows, members, sums, f"id {kind}, own string, key string, n long, s double").groupBy("id", "own", "key", "n").agg(F.sum("s").alias("s"))
    own = F.col("own") == F.col("key")
    s = per.groupBy("id").agg(F.max(F.when(own, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    of = s.select("id", F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0).alias("silhouette"))
    return base, points.join(of, "id").select("l", "v", "c", "silhouette")


def silhouette(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """id, silhouette (Euclidean): (b - a) / max(a, b), 0 for a cluster of one row.

    Exact: rows meet all rows of their own cluster, and of others only where bounds by cells leave it open which one is nearest. They meet block by block, summed in numpy, so what leaves a
    pair of blocks is one sum for each row, and a cluster of most rows is more tasks. The bounds' centres are CELLS rows for each cluster; clusters are few. Equal rows of a cluster meet once,
    with their number; with three features or more the rest is still quadratic in the different rows of a cluster. With one or two, many rows are met by blocks: `far.silhouettes`.
    """
    base, found = _silhouettes(df, features, label)
    return base.join(found.select("l", "v", "silhouette"), ["l", "v"]).select("id", "silhouette")


def _centroids(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias("c_" + c) for c in features))


def nearest_to_centre(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """label, id: the member nearest to each label's centroid, the least id on ties."""
    at = df.select("id", label, *features).join(F.broadcast(_centroids(df, features, label).drop("n")), label)
    d2 = reduce(lambda a, b: a + b, (F.pow(F.col(c) - F.col("c_" + c), F.lit(2.0)) for c in features))
    return at.groupBy(label).agg(F.min_by("id", F.struct(F.round(d2, 6), "id")).alias("id"))


def inertia(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """inertia: the sum of squared distances to the centroids, by variances in one pass."""
    each = df.groupBy(label).agg(reduce(lambda a, b: a + b, (F.var_pop(c) for c in features)).alias("v"), F.count("*").alias("n"))
    return each.agg(F.sum(F.col("v") * F.col("n")).alias("inertia"))


def calinski_harabasz(df: DataFrame, features: list[str], label: str) -> DataFrame:
    var = reduce(lambda a, b: a + b, (F.var_pop(c) for c in features))
    within = df.groupBy(label).agg(var.alias("v"), F.count("*").alias("m")).agg(F.sum(F.col("v") * F.col("m")).alias("ssw"), F.count("*").alias("k"))
    whole = df.agg((var * F.count("*")).alias("sst"), F.count("*").alias("n"))
    return within.crossJoin(whole).select((((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("ch"))


def davies_bouldin(df: DataFrame, features: list[str], label: str) -> DataFrame:
    c = _centroids(df, features, label)
    spread = df.select(label, *(F.col(f).alias("x_" + f) for f in features)).join(F.broadcast(c), label).withColumn("d", F.sqrt(_d2(features, "x_", "c_"))).groupBy(label).agg(F.avg("d").alias("s"))
    s = c.join(spread, label)
    a = s.select(F.col(label).alias("la"), F.col("s").alias("sa"), *(F.col("c_" + f).alias("a_" + f) for f in features))
    b = s.select(F.col(label).alias("lb"), F.col("s").alias("sb"), *(F.col("c_" + f).alias("b_" + f) for f in features))
    ratio = a.join(F.broadcast(b), F.col("la") != F.col("lb")).select("la", ((F.col("sa") + F.col("sb")) / F.sqrt(_d2(features, "a_", "b_"))).alias("r"))
    return ratio.groupBy("la").agg(F.max("r").alias("r")).agg(F.avg("r").alias("db"))


def scores(df: DataFrame, features: list[str], ks, starts: int = 20, assign=None, steps: int = 100) -> DataFrame:
    """k, silhouette, ch, db, inertia of each number of clusters, by k-means (all numbers of clusters and starts in the same steps) or by what assign(k) gives (df with cluster)."""
    out, centres = None, kmeans_of(df, features, list(ks), starts, steps) if assign is None else {}
    for k in ks:
        c = written(df.withColumn("cluster", nearest_centre(features, centres[k])) if assign is None else assign(k), "clusters")
        row = _silhouettes(c, features, "cluster")[1].agg(F.lit(k).alias("k"), (F.sum(F.col("c") * F.col("silhouette")) / F.sum("c")).alias("silhouette"))
        for index in (calinski_harabasz, davies_bouldin, inertia):
            row = row.crossJoin(index(c, features, "cluster"))
        out = row if out is None else out.unionByName(row)
    return written(out, "scores")


def majority_k(scores: DataFrame) -> DataFrame:
    """k that most criteria choose (silhouette and ch by their maximum, db by its minimum; the least k on ties). scores: k, silhouette, ch, db."""
    best = scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("a"), F.max_by("k", F.struct("ch", -F.col("k"))).alias("b"), F.min_by("k", F.struct("db", "k")).alias("c"))
    votes = best.select(F.explode(F.array("a", "b", "c")).alias("k")).groupBy("k").agg(F.count("*").alias("votes"))
    return votes.withColumn("__r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("votes").desc(), "k"))).where("__r = 1").drop("__r")
