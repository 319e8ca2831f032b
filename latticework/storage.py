"""Tables written to the folder that driver and executors share, to cut lineage and to read one result more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may fall back to a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="latticework-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query as soon as it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """df, written as Parquet and read back with its schema, so that whoever reads it sees the same rows in the same partitions. clean: the shuffles it took go at once, not when they are collected."""
    path, conf = new_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    if clean:
        conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table that `written` gave."""
    files = df.inputFiles()
    if files:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
