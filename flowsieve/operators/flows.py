"""Bidirectional flow assembly with idle and active timeouts.

A segment of a flow key ends before a packet that arrives more than `idle` after the previous one or
more than `active` after the segment's first packet. Packets are ordered by (ts_us, packet_id).

Ordinary keys: one shuffle by key. A window finds the idle sessions; packets are then summed into
atoms, one for the first `active` stretch of a session and one per later distinct time; the few
atoms of a session are folded into segments in the JVM. The fold, the sums and the window all reuse
the one partitioning by key.

Keys with more than `hot_key_rows` packets are summed per distinct time with map-side combine, and
every ordered step works on (key, tick) with one carry row per tick, so no task holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.text import has_bit
from flowsieve.operators.filters import valid_ports
from flowsieve.operators.thinning import greedy_chain
from flowsieve.options import Options
from flowsieve.session import settle

KEY = ["lo", "hi", "protocol"]
SUMS = ["lo_packets", "hi_packets", "lo_bytes", "hi_bytes", "syn_count", "ack_count", "fin_count", "rst_count"]
FIRST = ["lo_first", "hi_first"]


def flow_key(packets: DataFrame) -> DataFrame:
    """Unordered endpoint pair plus protocol: both directions of a flow share it."""
    src = F.concat(F.col("src_ip"), F.lit("|"), F.col("src_port").cast("string"))
    dst = F.concat(F.col("dst_ip"), F.lit("|"), F.col("dst_port").cast("string"))
    return packets.withColumns({"lo": F.least(src, dst), "hi": F.greatest(src, dst), "from_lo": src <= dst})


def keyed(packets: DataFrame) -> DataFrame:
    return flow_key(packets.filter(valid_ports())).select(
        *KEY, "from_lo", "ts_us", "packet_id", "size", "tcp_flags")


def packet_sums() -> list[Column]:
    lo, tcp = F.col("from_lo"), F.col("protocol") == 6

    def flagged(bit: int, name: str) -> Column:
        return F.count_if(tcp & has_bit(F.col("tcp_flags"), bit)).alias(name)

    return [F.count_if(lo).alias("lo_packets"), F.count_if(~lo).alias("hi_packets"),
            F.sum(F.when(lo, F.col("size")).otherwise(0)).alias("lo_bytes"),
            F.sum(F.when(lo, 0).otherwise(F.col("size"))).alias("hi_bytes"),
            flagged(0x02, "syn_count"), flagged(0x10, "ack_count"),
            flagged(0x01, "fin_count"), flagged(0x04, "rst_count")]


def first_ids(at_start: Column) -> list[Column]:
    """Lowest packet id per direction among the packets at the start time: orients the flow."""
    return [F.min(F.when(at_start & F.col("from_lo"), F.col("packet_id"))).alias("lo_first"),
            F.min(F.when(at_start & ~F.col("from_lo"), F.col("packet_id"))).alias("hi_first")]


def idle_sessions(keyed: DataFrame, opts: Options) -> DataFrame:
    """Adds session_start: the time of the first packet after the last gap longer than idle."""
    ordered = Window.partitionBy(*KEY).orderBy("ts_us", "packet_id")
    gap = F.col("ts_us") - F.lag("ts_us").over(ordered)
    opens = gap.isNull() | (gap > opts.idle_us)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (keyed.withColumn("opened", F.when(opens, F.col("ts_us")))
            .withColumn("session_start", F.max("opened").over(so_far)).drop("opened"))


def _ordinary_segments(keyed: DataFrame, opts: Options) -> DataFrame:
    sessions = idle_sessions(keyed, opts)
    late = F.col("ts_us") - F.col("session_start") > opts.active_us
    atoms = (sessions.withColumn("at", F.when(late, F.col("ts_us")).otherwise(F.col("session_start")))
             .groupBy(*KEY, "session_start", "at")
             .agg(F.max("ts_us").alias("last_us"), *packet_sums(), *first_ids(F.col("ts_us") == F.col("at"))))
    names = ["last_us", *SUMS, *FIRST]
    packed = F.struct(F.col("at").alias("start_us"), *names)

    def grown(segment: Column, atom: Column) -> Column:
        return F.struct(segment["start_us"].alias("start_us"), atom["last_us"].alias("last_us"),
                        *[(segment[n] + atom[n]).alias(n) for n in SUMS],
                        *[segment[n].alias(n) for n in FIRST])

    def step(state: Column, atom: Column) -> Column:
        fresh = F.struct(state["done"].alias("done"), atom.alias("open"))
        closed = F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), atom.alias("open"))
        longer = F.struct(state["done"].alias("done"), grown(state["open"], atom).alias("open"))
        return (F.when(state["open"].isNull(), fresh)
                .when(atom["start_us"] - state["open"]["start_us"] > opts.active_us, closed)
                .otherwise(longer))

    segment = "struct<start_us:bigint," + ",".join(f"{n}:bigint" for n in names) + ">"
    nothing = F.struct(F.array().cast(f"array<{segment}>").alias("done"), F.lit(None).cast(segment).alias("open"))
    folded = F.aggregate("atoms", nothing, step, lambda state: F.concat(state["done"], F.array(state["open"])))
    return (atoms.groupBy(*KEY, "session_start").agg(F.array_sort(F.collect_list(packed)).alias("atoms"))
            .select(*KEY, F.inline(folded)))


def _hot_segments(keyed: DataFrame, opts: Options) -> DataFrame:
    tick = F.floor(F.col("at") / F.lit(opts.tick_us)).cast("bigint")
    atoms = settle(keyed.withColumn("at", F.col("ts_us")).groupBy(*KEY, "at")
                   .agg(*packet_sums(), *first_ids(F.lit(True)))
                   .withColumn("tick", tick))
    in_tick = Window.partitionBy(*KEY, "tick").orderBy("at")
    by_tick = Window.partitionBy(*KEY).orderBy("tick")
    before = by_tick.rowsBetween(Window.unboundedPreceding, -1)
    carried = (atoms.groupBy(*KEY, "tick").agg(F.max("at").alias("tick_last"))
               .select(*KEY, "tick", F.lag("tick_last").over(by_tick).alias("carried_last")))
    gap = F.col("at") - F.coalesce(F.lag("at").over(in_tick), F.col("carried_last"))
    opened = settle(atoms.join(carried, KEY + ["tick"])
                    .withColumn("opened", F.when(gap.isNull() | (gap > opts.idle_us), F.col("at")))
                    .drop("carried_last"))
    start_carry = (opened.groupBy(*KEY, "tick").agg(F.max("opened").alias("tick_opened"))
                   .select(*KEY, "tick", F.last("tick_opened", ignorenulls=True).over(before).alias("carried_start")))
    so_far = in_tick.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sessions = settle(opened.join(start_carry, KEY + ["tick"])
                      .withColumn("session_start", F.coalesce(F.max("opened").over(so_far), F.col("carried_start")))
                      .drop("opened", "carried_start", "tick"))
    group = KEY + ["session_start"]
    chain = greedy_chain(sessions.select(*group, F.col("at").alias("t")), group, opts.active_us, True,
                         opts.tick_us, opts.hot_key_rows)
    # segment starts of a session lie more than `active` apart, so an `active`-wide slot meets at most two
    width = F.lit(max(1, opts.active_us))
    slot = lambda c: F.floor(c / width).cast("bigint")
    follow = Window.partitionBy(*group).orderBy("start_us")
    bounds = (settle(chain.withColumnRenamed("t", "start_us"))
              .withColumn("next_us", F.lead("start_us").over(follow))
              .withColumn("slot", F.explode(F.sequence(slot(F.col("start_us")), slot(F.col("start_us") + width)))))
    placed = (sessions.withColumn("slot", slot(F.col("at"))).join(bounds, group + ["slot"])
              .filter("at >= start_us AND (next_us IS NULL OR at < next_us)"))
    first = F.col("at") == F.col("start_us")
    return placed.groupBy(*KEY, "start_us").agg(
        F.max("at").alias("last_us"), *[F.sum(n).alias(n) for n in SUMS],
        *[F.min(F.when(first, F.col(n))).alias(n) for n in FIRST])


def oriented(segments: DataFrame) -> DataFrame:
    """Forward is the direction of the first packet."""
    forward = F.col("hi_first").isNull() | (F.col("lo_first") < F.col("hi_first"))
    forward = F.coalesce(forward, F.lit(False))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    part = lambda c, i: F.substring_index(c, "|", i)
    return segments.withColumns({"src": pick("lo", "hi"), "dst": pick("hi", "lo")}).select(
        F.least("lo_first", "hi_first").alias("flow_id"), "protocol",
        part("src", 1).alias("src_ip"), part("dst", 1).alias("dst_ip"),
        part("src", -1).cast("int").alias("src_port"), part("dst", -1).cast("int").alias("dst_port"),
        "start_us", "last_us",
        pick("lo_packets", "hi_packets").alias("fwd_packets"), pick("hi_packets", "lo_packets").alias("bwd_packets"),
        pick("lo_bytes", "hi_bytes").alias("fwd_bytes"), pick("hi_bytes", "lo_bytes").alias("bwd_bytes"),
        "syn_count", "ack_count", "fin_count", "rst_count")


def assemble(packets: DataFrame, opts: Options) -> DataFrame:
    """Packets to completed flows, one row per segment; `flow_id` is the first packet's id."""
    rows = keyed(packets)
    hot = settle(rows.groupBy(*KEY).count().filter(F.col("count") > opts.hot_key_rows).select(*KEY))
    if hot.isEmpty():
        return oriented(_ordinary_segments(rows, opts))
    # at most (all rows / hot_key_rows) keys; Spark broadcasts them when they fit its size limit
    ordinary = _ordinary_segments(rows.join(hot, KEY, "left_anti"), opts)
    split = _hot_segments(rows.join(hot, KEY, "left_semi"), opts)
    return oriented(ordinary.unionByName(split))


def flow_totals(flows: DataFrame) -> DataFrame:
    return flows.withColumns({
        "total_packets": F.col("fwd_packets") + F.col("bwd_packets"),
        "total_bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "duration_us": F.greatest(F.lit(0).cast("bigint"), F.col("last_us") - F.col("start_us"))})
