"""Queries by name, each with the SQL to hold it against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 200 m squares, 40 to a row: customers as cells, with indicators of their orders."""
    orders = table(spark, sf_dir, "orders")
    o = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    li = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))
    base = grid(spark, sf_dir)
    return base.join(o, "id", "left").join(li, "id", "left")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells without indicators."""
    key = F.col("c_custkey")
    cx, cy = key % 40, F.floor(key / 40).cast("long")
    return table(spark, sf_dir, "customer").select(key.alias("id"), cx.alias("cx"), cy.alias("cy"), (cx * 200.0 + 100.0).alias("x"), (cy * 200.0 + 100.0).alias("y"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("nation"))


GRID_SQL = """grid AS (
  SELECT c_custkey AS id, c_custkey % 40 AS cx, c_custkey // 40 AS cy, CAST((c_custkey % 40) * 200 + 100 AS DOUBLE) AS x, CAST((c_custkey // 40) * 200 + 100 AS DOUBLE) AS y,
         c_acctbal AS bal, c_mktsegment AS kind, c_nationkey AS nation FROM customer)"""
CELLS_SQL = f"""{GRID_SQL},
o AS (SELECT o_custkey AS id, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY 1),
li AS (SELECT o_custkey AS id, avg(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax, avg(l_extendedprice) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
cells AS (SELECT grid.*, n_orders, spend, qty, disc, tax, price FROM grid LEFT JOIN o USING (id) LEFT JOIN li USING (id))"""
