"""Live counts: windows are counted inside the stream and upserted by window and batch.

The aggregation runs in update mode, so a batch delivers the windows it has changed, with their whole counts. They are written as
folder `batch=N`; a batch that comes again overwrites its own folder. A window's counts are those of its latest batch. Every
COMPACT_EVERY batches the latest counts are folded into one folder, so that the table has a row a window and a bounded number
of changes. Windows behind the watermark leave the state and stay in the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators.views import windowed_counts
from flowsieve.session import file_system
from flowsieve.streaming.live import finished

COMPACT_EVERY = 50
COLUMNS = ["window_us", "flows", "allows", "alerts", "blocks", "probes"]
_SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS)


@dataclass
class LiveCounts:
    spark: SparkSession
    folder: str
    compact_every: int = COMPACT_EVERY

    def handle(self, changed: DataFrame, batch_id: int) -> None:
        if batch_id in [n for n, _ in self._folders() if n >= batch_id]:
            return
        changed.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        self._compact(batch_id)

    def _folders(self) -> list[tuple[int, str]]:
        """(last batch, folder) of what is committed: the newest fold, then the batches after it."""
        files, at = file_system(self.spark, self.folder)
        if not files.exists(at(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at(self.folder))]
        done = [(int(n.split("=")[1]), n) for n in names if "=" in n and finished(self.spark, f"{self.folder}/{n}")]
        folds = [n for n, name in done if name.startswith("upto=")]
        start = max(folds, default=-1)
        return sorted((n, name) for n, name in done if (name.startswith("upto=") and n == start) or (name.startswith("batch=") and n > start))

    def _compact(self, batch_id: int) -> None:
        held = self._folders()
        if len(held) <= self.compact_every:
            return
        self.current().write.mode("overwrite").parquet(f"{self.folder}/upto={batch_id}")
        files, at = file_system(self.spark, self.folder)
        for _, name in held:
            files.delete(at(f"{self.folder}/{name}"), True)

    def current(self) -> DataFrame:
        """The counts of every window so far."""
        parts = [self.spark.read.schema(_SCHEMA).parquet(f"{self.folder}/{name}").withColumn("_batch", F.lit(n)) for n, name in self._folders()]
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        last = F.max_by(F.struct(*COLUMNS[1:]), F.col("_batch")).alias("s")
        return rows.groupBy("window_us").agg(last).select("window_us", "s.*")

    def start(self, events: DataFrame, width: str, delay: str, ts: str = "event_time", trigger: dict | None = None):
        """`events` is a stream of log records (type, action, and the time column)."""
        counts = windowed_counts(events.withWatermark(ts, delay), width, ts)
        return (counts.writeStream.foreachBatch(self.handle).outputMode("update")
                .option("checkpointLocation", f"{self.folder}-checkpoint").trigger(**(trigger or {"availableNow": True})).start())
