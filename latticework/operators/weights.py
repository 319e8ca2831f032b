"""Indicator weights and composite indices. The statistics are one row of sums and correlations; rows are read twice and never shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import minmax


def _sum(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def entropy_weights(df: DataFrame, cols: list[str]) -> DataFrame:
    """indicator, weight: (1 - H) / sum(1 - H), H = -sum p ln p / ln n, p = x / (sum x + 1e-12), 0 ln 0 = 0.

    With S = sum x + 1e-12, -sum p ln p = (sum x / S) ln S - sum(x ln x) / S: one pass of plain sums.
    """
    sums = df.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in cols), *(F.sum(F.when(F.col(c) > 0, F.col(c) * F.ln(c)).otherwise(0.0)).alias(f"t_{c}") for c in cols))
    total = lambda c: F.col(f"s_{c}") + 1e-12
    h = {c: (F.col(f"s_{c}") / total(c) * F.ln(total(c)) - F.col(f"t_{c}") / total(c)) / F.ln("n") for c in cols}
    return _long(sums, {c: 1 - h[c] for c in cols})


def critic_weights(df: DataFrame, cols: list[str], sample: bool = False) -> DataFrame:
    """indicator, weight: deviation times the sum of 1 - correlation with each indicator, normalised."""
    dev = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*(dev(c).alias(f"d_{c}") for c in cols), *(F.corr(a, b).alias(f"r_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j))
    r = lambda i, j: F.col(f"r_{min(i, j)}_{max(i, j)}")
    return _long(row, {c: F.col(f"d_{c}") * _sum([1 - r(i, j) for j in range(len(cols)) if j != i]) for i, c in enumerate(cols)})


def _long(row: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row's values, normalised, as rows of indicator and weight."""
    row = row.select(*(v.alias(c) for c, v in values.items()))
    total = _sum([F.col(c) for c in values])
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("indicator"), (F.col(c) / total).alias("weight")) for c in values))).alias("e")).select("e.*")


def combined_weights(entropy: DataFrame, critic: DataFrame, floor: float = 0.05) -> DataFrame:
    """indicator, entropy_w, critic_w, combined_w: the root of the product, normalised, raised to the floor (if all can have it) and normalised again."""
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(0))  # as many rows as indicators
    both = entropy.withColumnRenamed("weight", "entropy_w").join(critic.withColumnRenamed("weight", "critic_w"), "indicator")
    g = both.withColumn("g", F.sqrt(F.col("entropy_w") * F.col("critic_w"))).withColumn("m", F.count("*").over(every))
    g = g.withColumn("w", F.col("g") / F.sum("g").over(every)).withColumn("w", F.when(floor * F.col("m") < 1, F.greatest("w", F.lit(floor))).otherwise(F.col("w")))
    return g.select("indicator", "entropy_w", "critic_w", (F.col("w") / F.sum("w").over(every)).alias("combined_w"))


def _wide(weights: DataFrame, cols: list[str], column: str) -> DataFrame:
    return F.broadcast(weights.groupBy().pivot("indicator", cols).agg(F.first(column)).select(*(F.col(c).alias(f"w_{c}") for c in cols)))


def weighted_sum(df: DataFrame, cols: list[str], weights: DataFrame, column: str = "combined_w", out: str = "score") -> DataFrame:
    """df with the weighted sum of cols, brought to [0, 1]."""
    wide = df.crossJoin(_wide(weights, cols, column)).withColumn(out, _sum([F.col(c) * F.col(f"w_{c}") for c in cols]))
    return minmax(wide.drop(*(f"w_{c}" for c in cols)), [out])


def topsis(df: DataFrame, cols: list[str], weights: DataFrame, column: str = "combined_w", out: str = "score", cost: tuple[str, ...] = ()) -> DataFrame:
    """df with the closeness to the ideal, D- / (D+ + D-), 0.5 where both are 0; the ideal of a cost is its least."""
    v = {c: F.col(c) * F.col(f"w_{c}") for c in cols}
    wide = df.crossJoin(_wide(weights, cols, column)).withColumns({f"v_{c}": v[c] for c in cols})
    ideals = wide.agg(*(f(f"v_{c}").alias(f"{s}_{c}") for c in cols for f, s in ((F.max, "hi"), (F.min, "lo"))))
    wide = wide.crossJoin(F.broadcast(ideals))
    far = lambda best: F.sqrt(_sum([F.pow(F.col(f"v_{c}") - F.col(f"{'hi' if best == (c not in cost) else 'lo'}_{c}"), F.lit(2.0)) for c in cols]))
    plus, minus = far(True), far(False)
    return wide.withColumn(out, F.when(plus + minus > 0, minus / (plus + minus)).otherwise(0.5)).select(*df.columns, out)
