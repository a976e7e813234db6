"""Session settings the jobs rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles methods above 8000 bytes; a stage that large runs faster operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app_name: str = "flowsieve"):
    build = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    return build


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session may fall back to a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowsieve-"))
    return context.getCheckpointDir()


_scope: ContextVar[str | None] = ContextVar("flowsieve_scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(_scope.get() or shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Steps settled inside belong to the block and are removed when it ends; results must be written by then."""
    path = scratch_path(spark, "scope")
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        files, at = file_system(spark, path)
        files.delete(at(path), True)


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the function that makes its path objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def settle(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and continue from the written table.

    This cuts the lineage with one computation, survives the loss of executors, and gives Spark the
    true size, on which it then decides about broadcasts by itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Broadcast a join side only after counting it; a larger one is left to a shuffled join."""
    held = settle(df)
    return F.broadcast(held) if held.count() <= max_rows else held
