"""Greedy thinning of ordered times.

Within a group the first time is kept; then always the next time that lies more than `gap` after
the last kept one (`strict`), or at least `gap` after it. This one rule gives the active timeout of
flows and the cooldown of notifications.

Groups known to be small are folded inside the JVM. Otherwise every time gets a pointer to the time
that would be kept after it, and pointer doubling walks the chain in log2(steps) distributed rounds,
so that no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import settle


def fold_chain(times: DataFrame, group: list[str], gap: int, strict: bool) -> DataFrame:
    """Chain for groups of bounded size: one sorted array per group, folded once."""
    def step(state, t):
        apart = t - state["last"]
        far = (apart > gap) if strict else (apart >= gap)
        taken = F.struct(t.alias("last"), F.concat(state["kept"], F.array(t)).alias("kept"))
        return F.when(state["last"].isNull() | far, taken).otherwise(state)

    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    kept = F.aggregate("times", start, step, lambda state: state["kept"])
    return (times.groupBy(*group).agg(F.array_sort(F.collect_set("t")).alias("times"))
            .select(*group, F.explode(kept).alias("t")))


def _next_kept(times: DataFrame, group: list[str], gap: int, strict: bool, tick: int) -> DataFrame:
    """(group, t, nxt): the time kept after t, found inside one tick or as the next tick's first time."""
    at = lambda column: F.floor(F.col(column) / F.lit(tick)).cast("bigint")
    points = times.select(*group, F.col("t").alias("at"), F.col("t").alias("point"),
                          F.lit(None).cast("bigint").alias("t"), F.lit(1).alias("rank"))
    asked = times.select(*group, (F.col("t") + F.lit(gap)).alias("at"), F.lit(None).cast("bigint").alias("point"),
                         "t", F.lit(0 if strict else 2).alias("rank"))
    both = points.unionByName(asked).withColumn("tick", at("at"))
    later = (Window.partitionBy(*group, "tick").orderBy(F.desc("at"), "rank")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = (both.withColumn("near", F.min("point").over(later))
            .filter("t IS NOT NULL").select(*group, "t", "tick", "near"))
    # one row per tick: bounded by the time span, not by the number of packets
    ticks = both.groupBy(*group, "tick").agg(F.min("point").alias("first"))
    after = Window.partitionBy(*group).orderBy(F.desc("tick")).rowsBetween(Window.unboundedPreceding, -1)
    far = ticks.select(*group, "tick", F.last("first", ignorenulls=True).over(after).alias("far"))
    return (near.join(far, group + ["tick"], "left")
            .select(*group, "t", F.coalesce("near", "far").alias("nxt")).filter("nxt IS NOT NULL"))


def doubled_chain(times: DataFrame, group: list[str], gap: int, strict: bool, tick: int) -> DataFrame:
    times = settle(times.select(*group, "t").distinct())
    jump = settle(_next_kept(times, group, gap, strict, tick))
    kept = settle(times.groupBy(*group).agg(F.min("t").alias("t")))
    while not jump.isEmpty():
        reached = kept.join(jump, group + ["t"]).select(*group, F.col("nxt").alias("t"))
        onward = jump.select(*group, F.col("t").alias("nxt"), F.col("nxt").alias("beyond"))
        kept = settle(kept.unionByName(reached))
        jump = settle(jump.join(onward, group + ["nxt"]).select(*group, "t", F.col("beyond").alias("nxt")))
    return kept


def greedy_chain(times: DataFrame, group: list[str], gap: int, strict: bool,
                 tick: int, fold_rows: int) -> DataFrame:
    """Kept (group, t). Groups above `fold_rows` distinct times go through pointer doubling."""
    times = times.select(*group, "t").distinct()
    if gap <= 0 and not strict:
        return times
    sizes = times.groupBy(*group).count()
    large = sizes.filter(F.col("count") > fold_rows).select(*group)
    if large.isEmpty():
        return fold_chain(times, group, gap, strict)
    small = fold_chain(times.join(large, group, "left_anti"), group, gap, strict)
    return small.unionByName(doubled_chain(times.join(large, group, "left_semi"), group, gap, strict, tick))
