"""Order: dense indices, top rows, frontiers, deterministic splits and samples."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.expr import arithmetic_hash
from latticework.storage import written


def ranged(df: DataFrame, order: list[str], label: str = "ranged") -> DataFrame:
    """df sorted by range and written, with __p (the number of its partition) and __row (its place there, from 0).

    Two uses of an unwritten range exchange may have different bounds (each samples its own, perhaps pruned, input), so numbers of one don't fit the other.
    """
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    return written(placed.withColumns({"__p": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"), label)


def _before(parts: DataFrame, column: str) -> DataFrame:
    """__q, __b: the sum of column over the partitions before each; parts has a row for each partition."""
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(F.col("__p").alias("__q"), (F.sum(column).over(w) - F.col(column)).alias("__b"))


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0, 1, 2, ... in order, without bringing all rows to one task: rows are sorted by range, and each partition starts after those before it."""
    local = ranged(df, order)
    before = _before(local.groupBy("__p").agg(F.count("*").alias("__n")), "__n")
    return local.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__row")).drop("__p", "__q", "__row", "__b")


def running_total(df: DataFrame, order: list[str], column: str, name: str = "total") -> DataFrame:
    """The sum of column over each row and all before it in order, by sorted ranges: sums inside of a partition, and those of the partitions before."""
    local = ranged(df, order)
    inside = Window.partitionBy("__p").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    before = _before(local.groupBy("__p").agg(F.sum(column).alias("__n")), "__n")
    return local.withColumn("__t", F.sum(column).over(inside)).join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__t")).drop("__p", "__q", "__row", "__b", "__t")


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float]) -> DataFrame:
    """One row: for each column an array of its exact, interpolated quantiles (null without values). All columns' distinct values are counted and put in order as sorted ranges together,
    so no task holds all values of a column.
    """
    value = F.explode(F.array(*(F.struct(F.lit(k).alias("__c"), F.col(c).cast("double").alias("__v")) for k, c in enumerate(cols)))).alias("e")
    counts = df.select(value).select("e.*").where(F.col("__v").isNotNull()).groupBy("__c", "__v").agg(F.count("*").alias("__n"))
    placed = written(running_total(counts, ["__c", "__v"], "__n", "__upto"), "quantiles")
    size = placed.groupBy("__c").agg(F.sum("__n").alias("__size"), F.min(F.col("__upto") - F.col("__n")).alias("__first"))
    at = F.array(*(F.struct(F.lit(k).alias("q"), (F.lit(float(q)) * (F.col("__size") - 1)).alias("pos")) for k, q in enumerate(shares)))
    asked = size.select("__c", "__first", F.explode(at).alias("a")).select("__c", "a.q", "a.pos", *((F.col("__first") + f("a.pos")).alias(n) for n, f in (("__lo", F.floor), ("__hi", F.ceil))))
    holds = lambda n: (F.col(n) >= F.col("__upto") - F.col("__n")) & (F.col(n) < F.col("__upto"))
    found = placed.join(F.broadcast(asked), "__c").where(holds("__lo") | holds("__hi")).groupBy("__c", "q", "pos").agg(F.min("__v").alias("a"), F.max("__v").alias("b"))
    found = found.select("__c", "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("v"))
    each = found.groupBy("__c").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda s: s["v"]).alias("v"))
    return each.groupBy().pivot("__c", list(range(len(cols)))).agg(F.first("v")).toDF(*cols)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Spark keeps n rows of each group before the shuffle (a window group limit)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def pareto_frontier(df: DataFrame, cost: str, gain: str, tie: str) -> DataFrame:
    """Rows with more gain than any row of less cost (or the same cost, more gain or a smaller tie).

    First each cost bucket (a quantile range of the cost) is reduced to its own frontier and the best gain of the buckets before it, which are as many as there
    are shuffle partitions; the rows that are left are few, and written before they are used twice.
    """
    order = [F.col(cost), F.col(gain).desc(), F.col(tie)]
    parted = df.repartitionByRange(cost).withColumn("__p", F.spark_partition_id())
    own = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn("__best", F.max(gain).over(own)).where(F.col("__best").isNull() | (F.col(gain) > F.col("__best"))).drop("__best")
    local = written(local, "frontiers")
    tops = local.groupBy("__p").agg(F.max(gain).alias("__top"))
    before = tops.select(F.col("__p").alias("__q"), F.max("__top").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__floor"))
    return local.join(F.broadcast(before), F.col("__p") == F.col("__q")).where(F.col("__floor").isNull() | (F.col(gain) > F.col("__floor"))).drop("__p", "__q", "__floor")


def upper_envelope(df: DataFrame, x: str, y: str, bins: int = 120) -> DataFrame:
    """x (a bin's centre), y: the largest y of each of `bins` half-open intervals of x (the largest x is in none), kept while it rises from right to left, and from the least x
    on at the height of the first one.
    """
    stats = df.agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    b = df.crossJoin(F.broadcast(stats)).where(F.col(x) < F.col("__b")).withColumn("bin", F.floor((F.col(x) - F.col("__a")) * bins / (F.col("__b") - F.col("__a"))).cast("long"))
    best = b.groupBy("bin").agg(F.max(y).alias(y))
    right = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("__m", F.max(y).over(right)).where(F.col("__m").isNull() | (F.col(y) > F.col("__m"))).crossJoin(F.broadcast(stats))
    kept = kept.select((F.col("__a") + (F.col("bin") + 0.5) * (F.col("__b") - F.col("__a")) / bins).alias(x), y, "__a")
    left = kept.agg(F.min_by(F.struct(x, y, "__a"), x).alias("e")).select("e.*").where(F.col(x) > F.col("__a")).select(F.col("__a").alias(x), y)
    return kept.select(x, y).unionByName(left)


def hash_split(df: DataFrame, key: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """df with split: exact shares, truncated as integers, in the order of a hash of the key. Shares are taken as the decimals they are written as: 0.7 of 90000 is 63000, not a little less."""
    n = df.count()
    a, b = (int(n * Decimal(str(share))) for share in (train, val))
    indexed = dense_index(df.withColumn("__h", arithmetic_hash(F.col(key))), ["__h", key], "__at")
    return indexed.withColumn("split", F.when(F.col("__at") < a, "train").when(F.col("__at") < a + b, "val").otherwise("test")).drop("__h", "__at")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(arithmetic_hash(F.col(key)), key).limit(n)
