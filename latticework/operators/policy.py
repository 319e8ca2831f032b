"""Constraint-aware interventions: benchmarks, lagging rows, capped changes, scores and spill-over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import expr as E


def group_benchmarks(df: DataFrame, by: str, stress: str, vitality: str, measures: list[str], least: int = 5, q: float = 0.85) -> DataFrame:
    """by and target_* : the q quantile of each measure among top performers (stress under its q25, vitality over its q75); of the whole group if it has fewer than `least`."""
    cut = df.groupBy(by).agg(F.percentile(stress, F.lit(0.25)).alias("__s"), F.percentile(vitality, F.lit(0.75)).alias("__v"))
    top = (F.col(stress) < F.col("__s")) & (F.col(vitality) > F.col("__v"))
    agg = [F.count(F.when(top, 1)).alias("__n")]
    for m in measures:
        agg += [F.percentile(F.when(top, F.col(m)), F.lit(q)).alias(f"__t_{m}"), F.percentile(m, F.lit(q)).alias(f"__a_{m}")]
    g = df.join(cut, by).groupBy(by).agg(*agg)
    return g.select(by, *(F.when(F.col("__n") >= least, F.col(f"__t_{m}")).otherwise(F.col(f"__a_{m}")).alias(f"target_{m}") for m in measures))


def lagging(df: DataFrame, by: str, stress: str, vitality: str, both: bool = False) -> DataFrame:
    """Rows of more stress than their group's mean or (with both: and) less vitality."""
    m = df.groupBy(by).agg(F.avg(stress).alias("__s"), F.avg(vitality).alias("__v"))
    a, b = F.col(stress) > F.col("__s"), F.col(vitality) < F.col("__v")
    return df.join(m, by).where(a & b if both else a | b).drop("__s", "__v")


def capped_change(df: DataFrame, current: str, target: str, built: str, share: float = 0.8) -> DataFrame:
    """df with cap, delta and blocked: the change to the target that the cap allows, never negative; blocked where the cap is what stops it."""
    df = df.withColumn("cap", E.green_cap(F.col(built), share))
    proposed = F.least(F.col(target), F.col("cap"))
    df = df.withColumn("delta", F.greatest(F.lit(0.0), proposed - F.col(current)))
    return df.withColumn("blocked", (F.least(F.col(target), F.col("cap")) == F.col("cap")) & (F.col("delta") > 0))


def has_capacity(df: DataFrame, current: str, shape: str, target_shape: str, least: float = 0.05, least_shape: float = 0.1) -> DataFrame:
    return df.where((F.col("cap") - F.col(current) > least) | (F.col(target_shape) - F.col(shape) > least_shape))


def score(df: DataFrame, gain: str, cost: str, penalty: float = 2.0, out: str = "score") -> DataFrame:
    return df.withColumn(out, F.col(gain) - penalty * F.col(cost))


def impact(df: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """by (null for all rows), n and the mean change, by one rollup."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.avg(F.col(after) - F.col(before)).alias("change"))


def spill_over(local: DataFrame, edges: DataFrame, gains: DataFrame, least: float = 1e-4) -> DataFrame:
    """id, own, neighbours, multiplier: the neighbours' summed gain over the own one, 0 where that is no more than `least`. local: id; gains: source, id, gain."""
    own = gains.where("source = id").select("id", F.col("gain").alias("own"))
    near = edges.select(F.col("src").alias("source"), F.col("dst").alias("id")).join(gains, ["source", "id"]).groupBy("source").agg(F.sum("gain").alias("neighbours")).withColumnRenamed("source", "id")
    out = local.select("id").join(own, "id", "left").join(near, "id", "left").fillna(0.0, ["own", "neighbours"])
    return out.withColumn("multiplier", F.when(F.abs("own") > least, F.col("neighbours") / F.col("own")).otherwise(0.0))


_PRIME = 2147483647


def draw(key, run, generation, candidate, k):
    """A number in [0, 1) that depends on its arguments only; whole-number arithmetic that any engine can follow (two squares modulo a prime, so that neighbours aren't alike)."""
    h = (key % _PRIME * 48271 + run * 69621 + generation * 16807 + candidate * 8191 + k * 131 + 11) % _PRIME
    h = (h * h + 7) % _PRIME
    h = (h * 48271 + 3) % _PRIME
    return ((h * h + 13) % _PRIME) / _PRIME


def evolve(fitness, bounds: list[tuple[float, float]], key: int, run: int = 0, *, population: int = 100, generations: int = 50, elite: int = 5, mutation: float = 0.3):
    """The best genes that a search within bounds finds, and their value. fitness(all candidates) gives their values. The better half survives; the `elite` best stay as they
    are, and the others are copies of survivors, of which `mutation` have one gene moved by a normal step of 0.5. All draws are hashes of (key, run, generation, candidate); genes have nine
    places, and values are compared to nine.
    """
    low, high = np.array([b[0] for b in bounds], float), np.array([b[1] for b in bounds], float)
    every, genes = np.arange(population, dtype=np.int64), np.arange(len(bounds), dtype=np.int64)
    pop = np.round(low + (high - low) * draw(key, run, 0, every[:, None], genes), 9)
    for step in range(generations):
        value = fitness(pop)
        order = np.argsort(-np.round(value, 9), kind="stable")
        pop, best = pop[order], float(value[order[0]])
        if step == generations - 1:
            break
        kid = every[elite:]
        u = lambda k: draw(key, run, step + 1, kid, k)  # noqa: B023, E731
        kids = pop[np.floor(u(100) * max(1, population // 2)).astype(int)]
        moved = np.flatnonzero(u(101) < mutation)
        gene = np.floor(u(102) * len(bounds)).astype(int)[moved]
        kids[moved, gene] += (0.5 * np.sqrt(-2 * np.log(np.maximum(u(103), 1e-9))) * np.cos(2 * np.pi * u(104)))[moved]
        pop = np.concatenate([pop[:elite], np.round(np.clip(kids, low, high), 9)])
    return pop[0], best


def genetic_search(nodes: DataFrame, fitness, bounds: list[tuple[float, float]], *, run: int = 42, **options) -> DataFrame:
    """id, genes, best: for each node (id, context: array of double) a search within bounds; fitness(context, genes of all candidates) gives their values. Nodes are
    independent, so they are dealt to tasks as rows. options: of evolve().
    """

    def search(batches):
        for b in batches:
            out = []
            for i, context in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                genes, best = evolve(lambda g, c=np.array(context): fitness(c, g), bounds, int(i), run, **options)
                out.append((i, genes.tolist(), best))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.float64())], names=["id", "genes", "best"])

    return nodes.select("id", "context").mapInArrow(search, "id long, genes array<double>, best double")
