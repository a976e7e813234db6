"""Block list: intervals with expiry, latest state, restore, and replay against packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.addresses import ip_family
from flowsieve.operators.ordering import with_next_time
from flowsieve.operators.policy import BLOCK
from flowsieve.options import Options
from flowsieve.session import settle

DAY_US = 86_400_000_000


def blocks_from_decisions(decisions: DataFrame, opts: Options) -> DataFrame:
    """Block rows of flat decisions; none in detect mode."""
    expires = F.col("ts_us") + F.lit(opts.block_us) if opts.block_us > 0 else F.lit(None).cast("bigint")
    chosen = decisions.filter((F.col("action") == BLOCK) & F.lit(opts.prevent_mode))
    return chosen.select(F.col("attacker_ip").alias("ip"), "flow_id", F.col("ts_us").alias("blocked_at_us"),
                         expires.alias("expires_at_us"), "reason", "source")


def split_by_family(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with family, rows whose address is no address)."""
    known = blocks.withColumn("family", ip_family(F.col("ip")))
    return known.filter("family IS NOT NULL"), known.filter("family IS NULL").drop("family")


def intervals(blocks: DataFrame, opts: Options) -> DataFrame:
    """[blocked_at, end): a later block of the address replaces the earlier one."""
    width = opts.block_us if opts.block_us > 0 else DAY_US
    closed = with_next_time(settle(blocks), ["ip"], "blocked_at_us", "flow_id", width, "replaced_at_us")
    return closed.withColumn("end_us", F.least("expires_at_us", "replaced_at_us"))


def latest(blocks: DataFrame) -> DataFrame:
    """State per address: the last block wins."""
    kept = F.struct("blocked_at_us", "flow_id", "expires_at_us", "reason", "source")
    last = F.max_by(kept, F.struct("blocked_at_us", "flow_id"))
    return blocks.groupBy("ip").agg(last.alias("state")).select("ip", "state.*")


def listed(blocks: DataFrame) -> DataFrame:
    return blocks.select("ip").distinct().orderBy("ip")


def newest_first(blocks: DataFrame) -> DataFrame:
    return latest(blocks).orderBy(F.desc("blocked_at_us"), F.desc("flow_id"))


def with_unblocks(blocks: DataFrame, unblocks: DataFrame) -> DataFrame:
    """State after blocks and unblocks (ip, ts_us): an unblock is a tombstone, the latest row wins.

    On equal times the unblock comes last, as it can only refer to a block already made.
    """
    ops = (blocks.select("ip", F.col("blocked_at_us").alias("at_us"), F.lit(0).alias("rank"), "flow_id",
                         F.col("expires_at_us"))
           .unionByName(unblocks.select("ip", F.col("ts_us").alias("at_us"), F.lit(1).alias("rank"),
                                        F.lit(0).cast("bigint").alias("flow_id"),
                                        F.lit(None).cast("bigint").alias("expires_at_us"))))
    last = F.max_by(F.struct("at_us", "rank", "expires_at_us"), F.struct("at_us", "rank", "flow_id"))
    return (ops.groupBy("ip").agg(last.alias("s")).filter("s.rank = 0")
            .select("ip", F.col("s.at_us").alias("blocked_at_us"), F.col("s.expires_at_us").alias("expires_at_us")))


def unblocked(active_blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested address, whether it was blocked."""
    here = active_blocks.select("ip").distinct().withColumn("_hit", F.lit(True))
    return (requests.select("ip").distinct().join(here, "ip", "left")
            .select("ip", F.coalesce("_hit", F.lit(False)).alias("present")))


def active(state: DataFrame, now_us: int) -> DataFrame:
    """Blocks to restore at `now`; permanent ones stay permanent, expired ones are dropped."""
    return (state.filter(F.col("expires_at_us").isNull() | (F.lit(now_us) < F.col("expires_at_us")))
            .withColumn("remaining_us", F.col("expires_at_us") - F.lit(now_us)))


def enforce(packets: DataFrame, block_intervals: DataFrame, opts: Options) -> DataFrame:
    """Adds `dropped`: the packet's source is inside one of its block intervals.

    Intervals of an address that touch or overlap are merged first, so a packet meets at most one and a
    flood of blocks on one address leaves few. Intervals with an end are looked up by (address, time slice), which also spreads a busy address over its slices; the
    one open-ended interval an address can have is looked up by address.
    """
    block_intervals = settle(block_intervals)
    width = F.lit(opts.block_us if opts.block_us > 0 else DAY_US)
    slice_of = lambda c: F.floor(c / width).cast("bigint")
    by_ip = Window.partitionBy("ip").orderBy("blocked_at_us", "end_us")
    reached = F.max("end_us").over(by_ip.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reached.isNull() | (F.col("blocked_at_us") > reached)).cast("int")
    merged = (block_intervals.filter("end_us IS NOT NULL AND end_us > blocked_at_us").withColumn("begins", begins)
              .withColumn("island", F.sum("begins").over(by_ip.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .groupBy("ip", "island").agg(F.min("blocked_at_us").alias("blocked_at_us"), F.max("end_us").alias("end_us")))
    ended = (merged
             .select("ip", F.col("blocked_at_us").alias("from_us"), "end_us",
                     F.explode(F.sequence(slice_of(F.col("blocked_at_us")), slice_of(F.col("end_us") - 1)))
                     .alias("slice")))
    open_ended = (block_intervals.filter("end_us IS NULL").groupBy("ip")
                  .agg(F.max("blocked_at_us").alias("open_from_us")))
    p = packets.withColumn("slice", slice_of(F.col("ts_us"))).alias("p")
    e, o = ended.alias("e"), open_ended.alias("o")
    inside = ((F.col("p.src_ip") == F.col("e.ip")) & (F.col("p.slice") == F.col("e.slice"))
              & (F.col("p.ts_us") >= F.col("e.from_us")) & (F.col("p.ts_us") < F.col("e.end_us")))
    hit = F.col("e.ip").isNotNull() | F.coalesce(F.col("p.ts_us") >= F.col("o.open_from_us"), F.lit(False))
    return (p.join(e, inside, "left").join(o, F.col("p.src_ip") == F.col("o.ip"), "left")
            .select(*[F.col(f"p.{c}") for c in packets.columns], hit.alias("dropped")))
