"""Block notifications, thinned by a cooldown per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.text import notification_text
from flowsieve.operators.thinning import greedy_chain
from flowsieve.options import Options
from flowsieve.session import settle

FOLD_ROWS = 50_000


def requests(blocks: DataFrame, opts: Options) -> DataFrame:
    """One request per block and configured channel; without a channel there is none."""
    channel = opts.notify_channel or ""
    return (blocks.filter(F.lit(bool(channel)))
            .select(F.lit(channel).alias("channel"), F.col("blocked_at_us").alias("ts_us"), "flow_id", "ip",
                    "reason", "source"))


def accepted(asked: DataFrame, opts: Options, fold_rows: int = FOLD_ROWS, clock: DataFrame | None = None) -> DataFrame:
    """Requests that pass the cooldown; only an accepted one moves the clock.

    Requests at one time collapse to the first before the ordered step, which then sees distinct
    times. `clock` (channel, last_us) continues from an earlier run: the time last accepted counts as
    the start of the chain, and requests before it are rejected.
    """
    if opts.cooldown_us == 0:
        return asked
    if clock is not None:
        asked = asked.join(clock, "channel", "left").filter("last_us IS NULL OR ts_us > last_us").drop("last_us")
    first = settle(asked.groupBy("channel", "ts_us")
                   .agg(F.min_by(F.struct("flow_id", "ip", "reason", "source"), F.col("flow_id")).alias("r"))
                   .select("channel", "ts_us", "r.*"))
    times = first.select("channel", F.col("ts_us").alias("t"))
    if clock is not None:
        times = times.unionByName(clock.select("channel", F.col("last_us").alias("t")))
    chain = greedy_chain(times, ["channel"], opts.cooldown_us, False, opts.cooldown_us, fold_rows)
    return first.join(chain.withColumnRenamed("t", "ts_us"), ["channel", "ts_us"])


def outbox(passed: DataFrame) -> DataFrame:
    """Rendered messages; delivering them is outside this library."""
    return passed.withColumn("message", notification_text(
        F.col("ip"), F.col("reason"), F.col("source"), F.timestamp_micros("ts_us")))


def counters(delivered: DataFrame) -> DataFrame:
    """Accepted and sent per channel; a failed delivery lowers `sent` only."""
    return delivered.groupBy("channel").agg(
        F.count("*").alias("accepted"), F.count_if(F.col("status") != "failed").alias("sent"))
