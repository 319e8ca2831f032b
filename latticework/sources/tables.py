"""Plain tables: CSV in and out, correlation matrices, cached tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """one_file is for small results: all rows then go through one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def matrix(pairs: DataFrame, names: list[str], label: str = "feature") -> DataFrame:
    """The square, symmetric matrix of pairs (a, b, r), ones on the diagonal, with the row's name in the first column."""
    both = pairs.select("a", "b", "r").union(pairs.select("b", "a", "r"))
    own = pairs.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "a string, b string, r double")
    return both.union(own).groupBy(F.col("a").alias(label)).pivot("b", names).agg(F.first("r"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], least: int = 1000) -> DataFrame:
    """The Parquet table at path if it has more than `least` rows, else what make() gives, written there."""
    try:
        df = spark.read.parquet(path)
        if df.count() > least:
            return df
    except Exception as e:  # noqa: BLE001  Spark's own error classes differ by version
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def flatten(df: DataFrame, array: str) -> DataFrame:
    """A row for each element of an array of structs, its fields beside the other columns; rows without elements stay once."""
    return df.withColumn("__e", F.explode_outer(array)).select(*[c for c in df.columns if c != array], "__e.*")
