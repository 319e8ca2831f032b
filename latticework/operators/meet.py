"""Rows that meet rows of the same key, block by block, however many either side has."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK_ROWS = 8192


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    return df.groupBy("key").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))


def meetings(queries: DataFrame, members: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int | None = None, whole: bool = False) -> DataFrame:
    """What meet(queries, members) gives for each pair of blocks of the same key. Both have key and id; a block has about `rows` rows, by a hash of the id, so a key that most rows share is
    more pairs of blocks, not larger ones. A row is copied for the other side's blocks of its key only. whole: each block of queries meets all members of its key at once.
    """
    rows = rows or BLOCK_ROWS
    members = members.select(*(F.col(c).alias(c) for c in members.columns))  # both sides may be one table
    q, m = _blocks(queries, rows), members.select("key").distinct().withColumn("blocks", F.lit(1)) if whole else _blocks(members, rows)
    sizes = q.withColumnRenamed("blocks", "__q").join(m.withColumnRenamed("blocks", "__m"), "key")  # a row for each key
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every: Callable[[str], Column] = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "key").select("*", part("__q").alias("__i"), every("__m").alias("__j")).drop("__q", "__m")
    right = members.join(sizes, "key").select("*", part("__m").alias("__j"), every("__q").alias("__i")).drop("__q", "__m")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return meet(a.drop_columns(["__i", "__j"]), b.drop_columns(["__i", "__j"]))

    return left.groupBy("key", "__i", "__j").cogroup(right.groupBy("key", "__i", "__j")).applyInArrow(run, schema)
