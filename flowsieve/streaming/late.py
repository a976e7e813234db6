"""Late packets on a stream: a splitter in front of the stateful operators that keeps what they would drop.

Every micro-batch is written once, as folder `batch=N`, with its rows parted into on-time and late ones. The boundary of a batch is
known before it is read: the newest event time of the earlier batches less the delay, as Spark's own watermark moves. A batch
that has been written is left alone when it comes again, so each row is in one table, once. The newest times are one number a
batch, taken in the same job that writes the rows; a batch reads the last one only.

On-time rows are read again as a stream with the same delay. Reading several batches at once only holds the watermark back, so nothing
that was on time here is dropped there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowsieve.session import file_system
from flowsieve.streaming.live import finished

KEEP_MARKS = 2      # newest times that stay: the last one, and the one a retried batch starts from


@dataclass
class Splitter:
    spark: SparkSession
    folder: str
    delay_us: int
    time: str = "ts_us"
    schema: StructType | None = None        # of the rows; `start` takes it from the stream

    def handle(self, rows: DataFrame, batch_id: int) -> None:
        marks = self._marks(batch_id)
        if batch_id in marks:
            return
        before = marks[max(marks)] if marks else None
        path = f"{self.folder}/rows/batch={batch_id}"
        if finished(self.spark, path):         # written, but not marked: the newest time is read again
            newest = self._read([path]).agg(F.max(self.time)).first()[0]
        else:
            seen = Observation("newest")
            late = F.lit(False) if before is None else F.col(self.time) <= F.lit(before // 1000 * 1000 - self.delay_us)
            rows.observe(seen, F.max(self.time).alias("us")).withColumn("late", F.coalesce(late, F.lit(False))) \
                .write.mode("overwrite").partitionBy("late").parquet(path)
            newest = seen.get["us"]
        newest = max((n for n in (before, newest) if n is not None), default=None)
        files, at = file_system(self.spark, self.folder)
        files.createNewFile(at(f"{self.folder}/newest/{batch_id}.{'' if newest is None else newest}"))
        for old in sorted(marks)[:1 - KEEP_MARKS]:
            files.delete(at(f"{self.folder}/newest/{old}.{'' if marks[old] is None else marks[old]}"), False)

    def _marks(self, upto: int) -> dict[int, int | None]:
        """The newest time up to each of the last batches; it is the name of an empty file, which is made in one step."""
        files, at = file_system(self.spark, self.folder)
        path = at(f"{self.folder}/newest")
        names = [s.getPath().getName().split(".") for s in files.listStatus(path)] if files.exists(path) else []
        return {int(n): int(us) if us else None for n, us in names if int(n) <= upto}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def start(self, rows: DataFrame, trigger: dict | None = None):
        self.schema = rows.schema
        return (rows.writeStream.foreachBatch(self.handle).option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def _table(self, late: bool) -> DataFrame:
        files, at = file_system(self.spark, self.folder)
        found = files.globStatus(at(f"{self.folder}/rows/batch=*/late={str(late).lower()}"))
        paths = [s.getPath().toString() for s in found or []]
        return self._read(paths) if paths else self.spark.createDataFrame([], self.schema)

    def on_time(self) -> DataFrame:
        return self._table(False)

    def quarantine(self) -> DataFrame:
        """The late rows."""
        return self._table(True)

    def on_time_stream(self, files_per_trigger: int = 1) -> DataFrame:
        return (self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger)
                .option("recursiveFileLookup", True).parquet(f"{self.folder}/rows/batch=*/late=false"))
