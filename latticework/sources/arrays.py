"""Arrays: .npy files as rows, a model's parameters as a Parquet table (never pickles)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """file, row, values (array of double): an array's rows, each a flat array; path is a file, folder or pattern. A file is read by one task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float) if a.ndim else a.reshape(1, 1).astype(float)
                for i in range(0, len(a), 10_000):
                    part = a[i : i + 10_000]
                    values = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), a.shape[1]).cast(pa.list_(pa.float64())) if a.shape[1] else pa.array([[]] * len(part), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), values], names=["file", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row long, values array<double>")


def write_npy(df: DataFrame, column: str, path: str) -> None:
    """An array column as .npy files in a folder: each task writes one for each batch, by its number, so that a repeated task writes the same files again."""
    from .files import created

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            values = np.array(b.column(0).to_pylist(), float)
            if len(values):
                with created(f"{path}/part-{part:05d}-{k:05d}.npy") as f:
                    out = io.BytesIO()
                    np.save(out, values)
                    f.write(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64())], names=["n"])

    df.where(f"`{column}` IS NOT NULL").select(column).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def write_parameters(spark: SparkSession, parameters: dict[str, np.ndarray], path: str) -> None:
    rows = [(n, list(map(int, np.shape(v))), np.asarray(v, float).ravel().tolist()) for n, v in sorted(parameters.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def parameter_table(spark: SparkSession, path: str) -> DataFrame:
    """name, row, col, value of the matrices that are stored at path (vectors have one row): a table to join with."""
    stored = spark.read.schema("name string, shape array<int>, values array<double>").parquet(path)
    cols = F.when(F.size("shape") > 1, F.col("shape")[1]).otherwise(F.size("values"))
    flat = stored.select("name", cols.alias("cols"), F.posexplode("values").alias("at", "value"))
    return flat.select("name", F.floor(F.col("at") / F.col("cols")).cast("int").alias("row"), (F.col("at") % F.col("cols")).cast("int").alias("col"), "value")


def read_parameters(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A model's parameters, which fit the driver as the model does."""
    return {r.name: np.array(r.values, float).reshape(r.shape) for r in spark.read.parquet(path).collect()}
