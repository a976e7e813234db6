"""Small state tables kept by foreachBatch: one version per micro-batch, so a retried batch rewrites its own.

Two versions stay: the newest, and the one before it, which a retry of the newest batch starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.session import file_system


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def versions(self) -> list[int]:
        files, at = file_system(self.spark, self.path)
        if not files.exists(at(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at(self.path))]
        done = [n for n in names if n.startswith("v=") and files.exists(at(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def before(self, batch_id: int) -> DataFrame:
        """State that earlier batches left."""
        older = [v for v in self.versions() if v < batch_id]
        return self._read(older[-1]) if older else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        versions = self.versions()
        return self._read(versions[-1]) if versions else self.spark.createDataFrame([], self.schema)

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def write(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        files, at = file_system(self.spark, self.path)
        for version in [v for v in self.versions() if v < batch_id][:-1]:
            files.delete(at(f"{self.path}/v={version}"), True)
