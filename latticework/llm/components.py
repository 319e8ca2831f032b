"""Connected components of a table of links, by alternating large and small stars; links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stamp(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node that it reaches), for each node with a link. links: a, b (long). Null ends and loops are left out.

    Large star: each node's larger neighbours go to the smallest of its neighbours and itself. Small star: a node and its smaller neighbours go to
    the smallest of them. The rounds needed grow with the logarithm of a component's size. Minima are partly taken before the shuffle, so that a node with most links is
    no burden, and the joins that follow can be split where they are skewed.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    scratch, round_ = Scratch(links.sparkSession, "components"), 0
    edges = scratch.write(edges, "0")
    before = None
    while (now := _stamp(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = scratch.write(small, f"{round_ + 1}")
        scratch.drop(f"{round_}")
        round_ += 1
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))
