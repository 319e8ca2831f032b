"""Statistics: correlation, collinearity, ranks, regression metrics, histograms, spatial autocorrelation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.storage import written


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r for a before b: every pair in one aggregate row."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def average_ranks(df: DataFrame, cols: list[str], prefix: str = "rank_") -> DataFrame:
    """df with ranks, ties by their mean. Ranks come from counts of distinct values, put in order as sorted ranges."""
    from .rank import running_total

    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        ranks = running_total(counts, ["__v"], "__n", "__sum").select("__v", (F.col("__sum") - (F.col("__n") - 1) / 2).alias(prefix + c))
        df = df.join(ranks, F.col(c) == F.col("__v"), "left").drop("__v")
    return df


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """r and n: Pearson's correlation of average ranks."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_ranks(both, [a, b]).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("r"), F.count("*").alias("n"))


def spearman_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r, n for a before b, over rows that have all of cols: one set of ranks, one aggregate row."""
    ranked = average_ranks(df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)).select(*cols), cols)
    pairs = correlation_pairs(ranked.select(*(F.col(f"rank_{c}").alias(c) for c in cols)), cols)
    return pairs.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n"))))


def pair_type(pairs: DataFrame, new: list[str]) -> DataFrame:
    """pairs (a, b, ...) with pair_type: whether both, one or none of the features are new."""
    a, b = F.col("a").isin(new), F.col("b").isin(new)
    return pairs.withColumn("pair_type", F.when(a & b, "new x new").when(a | b, "new x orig").otherwise("orig x orig"))


def vif_report(vifs: DataFrame, above: float = 10.0) -> DataFrame:
    """feature, vif, pos of those above a limit, the greatest first; there are as many rows as features."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("vif", 6).desc(), "feature")
    return vifs.where(F.col("vif") > above).withColumn("pos", F.row_number().over(order))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by the t distribution, from the regularised incomplete beta function (continued fraction)."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    t2, df = r * r * (n - 2) / (1 - r * r), n - 2
    return _incomplete_beta(df / 2, 0.5, df / (df + t2))


def with_p(df: DataFrame) -> DataFrame:
    """df (r, n: a row for each correlation) with p, its two-sided significance."""

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) if a == a else None for a, b in zip(r, n, strict=True)], dtype="float64")

    return df.withColumn("p", p_of(F.col("r").cast("double"), F.col("n").cast("long")))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """feature, vif: the diagonal of the inverse correlation matrix, which is as small as the number of features."""
    r = np.eye(len(cols))
    for row in correlation_pairs(df, cols).collect():
        i, j = cols.index(row.a), cols.index(row.b)
        r[i, j] = r[j, i] = row.r
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, np.diag(np.linalg.inv(r)), strict=True)], "feature string, vif double")


def regression_metrics(df: DataFrame, truth: str, guess: str, by: list[str] = ()) -> DataFrame:
    """rmse, mae, r2. The total sum of squares is a variance, so one pass is enough."""
    e = F.col(truth) - F.col(guess)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(F.lit(1)))).alias("r2"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0) and n; the upper edge belongs to the last bin."""
    k = F.least(F.floor((F.col(column) - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(column).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.median(column).alias("median"), F.max(column).alias("max"))


def row_standardised(edges: DataFrame) -> DataFrame:
    """Weights that sum to 1 for each src; a sum of 0 counts as 1."""
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", F.col("w") / F.when(total == 0, 1.0).otherwise(total))


def spatial_lag(nodes: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """node id, the column, lag: the weighted sum of neighbours' values (0 without neighbours)."""
    near = edges.join(nodes.select(F.col("id").alias("dst"), F.col(column).alias("__v")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("__v")).alias("lag"))
    return nodes.select("id", column).join(near, "id", "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))


def morans_i(nodes: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """i, n: (n / S0) sum z_i lag_i / sum z_i**2 over row-standardised edges (src, dst, w)."""
    z = nodes.crossJoin(F.broadcast(nodes.agg(F.avg(column).alias("__m")))).select("id", (F.col(column) - F.col("__m")).alias("z"))
    std = row_standardised(edges)
    lagged = spatial_lag(z, std, "z")
    s0 = std.agg(F.sum("w").alias("s0"))
    return lagged.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("lag")).alias("a"), F.sum(F.col("z") * F.col("z")).alias("b")).crossJoin(s0).select((F.col("n") / F.col("s0") * F.col("a") / F.col("b")).alias("i"), "n")


def morans_p(nodes: DataFrame, edges: DataFrame, column: str, permutations: int = 999, seed: int = 42, at_once: int = 200, block: Column | None = None) -> DataFrame:
    """i, p: the share of permuted fields whose I is as extreme, (k + 1) / (permutations + 1). No row where I isn't defined.

    Each permutation orders nodes by a seeded hash and gives the values out in that order. A plan holds at_once of them, as an array for each node, so edges meet nodes once a plan.
    With block (a number for each node, alike for near ones; a block has to fit in a task), edges meet fields inside of blocks (`permute.products`), and a plan's tables go before the next one.
    """
    from .permute import products
    from .rank import dense_index

    spark = nodes.sparkSession
    mean, n, b = nodes.agg(F.avg(column).alias("m"), F.count("*").alias("n")).crossJoin(nodes.agg(F.var_pop(column).alias("v"), F.count(column).alias("k"))).select("m", "n", F.col("v") * F.col("k")).first()
    if block is not None:
        s0, found = products(nodes, edges, column, float(mean), permutations, seed, at_once, block) if n and b else (None, [])
        return _judged(spark, n, b, s0, found if s0 else [], permutations)
    base, std = dense_index(nodes.select("id", column), ["id"], "k"), written(row_standardised(edges).select("src", "dst", "w"), "edges")
    s0 = std.agg(F.sum("w")).first()[0]
    found = []
    values = base.select(F.col("k").alias("place"), (F.col(column) - mean).alias("z")) if n and b and s0 else None
    for first in range(0, permutations + 1, at_once) if values is not None else ():
        last = min(first + at_once - 1, permutations)
        runs = base.select("id", "k", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("run"))
        runs = runs.withColumn("h", F.when(F.col("run") == 0, F.lpad(F.col("k").cast("string"), 32, "0")).otherwise(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("run").cast("string"), F.lit(str(seed)))))).drop("k")
        placed = dense_index(runs, ["run", "h", "id"], "at").withColumn("place", F.col("at") - (F.col("run") - first) * n).join(values, "place")
        field = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "z"))), lambda s: s["z"]).alias("z"))
        ends = std.join(field.select(F.col("id").alias("src"), F.col("z").alias("zi")), "src").join(field.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst")
        found += ends.agg(*(F.sum(F.col("w") * F.col("zi")[r] * F.col("zj")[r]).alias(f"a{r}") for r in range(last - first + 1))).first()
    return _judged(spark, n, b, s0, found, permutations)


def _judged(spark: SparkSession, n: int, b: float, s0: float, found: list, permutations: int) -> DataFrame:
    found = [n / s0 * a / b for a in found if a is not None]
    k = sum(x >= found[0] for x in found[1:]) if found else 0
    return spark.createDataFrame([(found[0], (min(k, permutations - k) + 1) / (permutations + 1))] if found else [], "i double, p double")


def ols_line(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def least_squares(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Intercept and coefficients by the normal equations, whose sums are one aggregate row."""
    cols = [F.lit(1.0), *map(F.col, features)]
    k = len(cols)
    row = df.agg(*(F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i + 1)), *(F.sum(c * F.col(target)).alias(f"b{i}") for i, c in enumerate(cols))).first()
    a = np.array([[row[f"a{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(k)]), rcond=None)[0]


def shannon(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """by, n, entropy (natural logarithm) of the categories' shares: counts are summed twice, nothing else moves."""
    counts = df.groupBy(*by, category).agg(F.count("*").alias("__n"))
    n = F.sum("__n")
    return counts.groupBy(*by).agg(n.alias("n"), (F.ln(n) - F.sum(F.col("__n") * F.ln("__n")) / n).alias("entropy"))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
