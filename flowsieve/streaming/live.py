"""The live job: completed flows of each micro-batch go through the batch policy; state lives in tables.

Every output of a batch is written under its batch number, and a batch whose last output is there is left alone, so each flow
takes effect once. Callbacks come before that last output: a batch that failed halfway calls them again.

Flows complete in another order than their block times. A flow still to come can't have a time before the newest end
of a completed flow minus the watermark delay and the longer timeout. This bound is the job's horizon: the
cooldown decides requests before it in time order and lets later ones wait, so the accepted requests don't depend on
how the input was cut into batches, and blocks that had expired by then leave the state.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import blocks as bl
from flowsieve.operators import notify
from flowsieve.options import Options
from flowsieve.plans.detection import Outcome, decide_flows
from flowsieve.session import file_system, scratch_scope, settle
from flowsieve.sources import events as ev
from flowsieve.streaming.tables import VersionedTable

log = logging.getLogger("flowsieve.live")

BLOCKS = "ip string, blocked_at_us bigint, flow_id bigint, expires_at_us bigint, reason string, source string"
CLOCK = "channel string, last_us bigint"
WAITING = "channel string, ts_us bigint, flow_id bigint, ip string, reason string, source string"
HORIZON = "us bigint"
UNBLOCKS = "ip string, ts_us bigint"
# watermarks are kept in milliseconds
ROUNDING_US = 1000
LAST_BATCH = 1 << 62


def guarded(callback: Callable[[DataFrame], None] | None, rows: DataFrame, what: str) -> None:
    """A user function on the new rows; its failure is logged and never stops the stream."""
    if callback is None:
        return
    try:
        callback(rows)
    except Exception as failure:  # noqa: BLE001
        log.error("%s callback failed: %s", what, failure)


@dataclass
class Live:
    spark: SparkSession
    folder: str
    opts: Options
    verdicts: Callable[[DataFrame], DataFrame]            # completed flows to verdict rows
    on_block: Callable[[DataFrame], None] | None = None
    on_probe: Callable[[DataFrame], None] | None = None
    delay_us: int = 10_000_000                            # the watermark delay of the flows
    keep_expired_us: int = 0                              # how long expired blocks stay, for views of the past
    blocks: VersionedTable = field(init=False)
    clock: VersionedTable = field(init=False)
    waiting: VersionedTable = field(init=False)
    horizon: VersionedTable = field(init=False)

    def __post_init__(self) -> None:
        self.blocks = VersionedTable(self.spark, f"{self.folder}/blocks", BLOCKS)
        self.clock = VersionedTable(self.spark, f"{self.folder}/clock", CLOCK)
        self.waiting = VersionedTable(self.spark, f"{self.folder}/waiting", WAITING)
        self.horizon = VersionedTable(self.spark, f"{self.folder}/horizon", HORIZON)

    def handle(self, flows: DataFrame, batch_id: int) -> None:
        sent = f"{self.folder}/outbox/batch={batch_id}"
        if finished(self.spark, sent):     # a retried batch: everything is there already
            return
        if finished(self.spark, self._flushed):
            raise RuntimeError(f"the job in {self.folder} was flushed: its input has ended")
        with scratch_scope(self.spark):
            flows = settle(flows)          # every further read would run the stream's state operators again
            outcome = decide_flows(self.verdicts(flows), self.opts, with_notifications=False)
            horizon = self._moved_horizon(flows, batch_id)
            self._events(outcome, batch_id)
            self._blocks(outcome, horizon, batch_id)
            guarded(self.on_probe, outcome.probes, "on_probe")
            guarded(self.on_block, outcome.blocks, "on_block")
            self._notifications(notify.requests(outcome.blocks, self.opts), horizon, batch_id, sent)

    def flush(self) -> None:
        """Decides the waiting requests after a bounded input has ended; the job takes no batches after it."""
        if not finished(self.spark, self._flushed):
            with scratch_scope(self.spark):
                none = self.spark.createDataFrame([], WAITING)
                self._notifications(none, None, LAST_BATCH, self._flushed, decide_all=True)

    @property
    def _flushed(self) -> str:
        return f"{self.folder}/outbox/flush"

    def unblock(self, requests: DataFrame) -> None:
        """Takes back the blocks that the addresses (ip, ts_us) have at that time."""
        requests.selectExpr("ip", "CAST(ts_us AS BIGINT) AS ts_us").write.mode("append").parquet(f"{self.folder}/unblocks")

    def blocked(self, now_us: int) -> DataFrame:
        return bl.active(self._standing(self.blocks.current()), now_us)

    def _standing(self, blocks: DataFrame) -> DataFrame:
        """Blocks later than the last unblock of their address."""
        path = f"{self.folder}/unblocks"
        if not finished(self.spark, path):
            return blocks
        last = self.spark.read.schema(UNBLOCKS).parquet(path).groupBy("ip").agg(F.max("ts_us").alias("_freed"))
        return blocks.join(last, "ip", "left").filter("_freed IS NULL OR blocked_at_us > _freed").drop("_freed")

    def _moved_horizon(self, flows: DataFrame, batch_id: int) -> int | None:
        hold = self.delay_us + max(self.opts.idle_us, self.opts.active_us) + ROUNDING_US
        seen = flows.agg((F.max("last_us") - F.lit(hold)).alias("us")).unionByName(self.horizon.before(batch_id))
        us = seen.agg(F.max("us")).first()[0]
        self.horizon.write(batch_id, self.spark.createDataFrame([(us,)], HORIZON))
        return us

    def _events(self, outcome: Outcome, batch_id: int) -> None:
        path = f"{self.folder}/events/batch={batch_id}"
        if finished(self.spark, path):     # readers have seen these files already
            return
        ev.encode(outcome.events).write.mode("overwrite").partitionBy("type", "day").text(path)

    def _blocks(self, outcome: Outcome, horizon: int | None, batch_id: int) -> None:
        new = outcome.blocks.select(*[c.split()[0] for c in BLOCKS.split(", ")])
        state = self._standing(bl.latest(self.blocks.before(batch_id).unionByName(new)))
        if horizon is not None:
            state = state.filter(F.col("expires_at_us").isNull()
                                 | (F.col("expires_at_us") > F.lit(horizon - self.keep_expired_us)))
        self.blocks.write(batch_id, state)

    def _notifications(self, new: DataFrame, horizon: int | None, batch_id: int, sent: str, decide_all: bool = False) -> None:
        """Decides the requests before the horizon, or all of them; the others wait."""
        asked = self.waiting.before(batch_id).unionByName(new.select(*[c.split()[0] for c in WAITING.split(", ")]))
        ripe = F.lit(decide_all) if decide_all or horizon is None else F.col("ts_us") < F.lit(horizon)
        clock = self.clock.before(batch_id)
        passed = settle(notify.accepted(asked.filter(ripe), self.opts, clock=clock))
        self.waiting.write(batch_id, asked.filter(~ripe))
        moved = passed.select("channel", F.col("ts_us").alias("last_us")).unionByName(clock)
        self.clock.write(batch_id, moved.groupBy("channel").agg(F.max("last_us").alias("last_us")))
        notify.outbox(passed).write.mode("overwrite").parquet(sent)

    def start(self, completed_flows: DataFrame, trigger: dict | None = None):
        return (completed_flows.writeStream.foreachBatch(self.handle).outputMode("append")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def events(self) -> DataFrame:
        lines = self.spark.read.option("basePath", f"{self.folder}/events").option("pathGlobFilter", "part-*") \
            .text(f"{self.folder}/events/batch=*")
        return ev.decode(lines.select("value"))

    def outbox(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/outbox")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has been committed."""
    files, at = file_system(spark, path)
    return files.exists(at(f"{path}/_SUCCESS"))


def tail_events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Event-log stream: only files not seen before, offsets kept in the query's checkpoint."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", False)
             .schema("value string").text(folder))
    return ev.decode(lines)
