"""Dashboard questions over the event log: counts, feeds, trend, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.text import DASH, feed_protocol

HISTORY = 2000
NEWEST = ["ts_us", "seq"]


def newest(events: DataFrame, n: int) -> DataFrame:
    """Top n by (ts_us, seq), newest first: a per-partition top-n, not a full sort."""
    return events.orderBy(*[F.desc(c) for c in NEWEST]).limit(n)


def _is_action(action: str) -> Column:
    return (F.col("type") == "decision") & (F.col("action") == action)


def kpi_counts(events: DataFrame, history: int = HISTORY) -> DataFrame:
    """Counts over the last `history` records; flows count feature records and distinct verdict flows."""
    return newest(events, history).agg(
        F.count_if(F.col("type") == "flow.features").alias("flows"),
        F.count_distinct(F.when(F.col("type") == "verdict", F.col("flow_id"))).alias("verdict_flows"),
        F.count_if(_is_action("alert")).alias("alerts"),
        F.count_if(_is_action("block")).alias("blocks"),
        F.count_if(F.col("type") == "honeypot.probe").alias("probes"))


def feed(events: DataFrame, n: int = 40) -> DataFrame:
    """Latest decisions with endpoints, protocol name and label fallback."""
    src = F.concat(F.coalesce("flow.src_ip", F.lit("?")), F.lit(":"), F.coalesce(F.col("flow.src_port").cast("string"), F.lit("")))
    dst = F.concat(F.coalesce("flow.dst_ip", F.lit("?")), F.lit(":"), F.coalesce(F.col("flow.dst_port").cast("string"), F.lit("")))
    fallback = F.when(F.col("source") == "honeypot", F.lit("ANOMALY")).otherwise(F.lit(DASH))
    return newest(events.filter(F.col("type") == "decision"), n).select(
        "ts_us", "seq", feed_protocol(F.coalesce("flow.protocol", F.lit(0))).alias("protocol_name"),
        F.concat(src, F.lit(" → "), dst).alias("endpoint"),
        F.coalesce(F.nullif(F.col("label"), F.lit("")), fallback).alias("label"), "confidence",
        F.coalesce("novelty", F.lit(False)).alias("novelty"), "action", "attacker_ip",
        F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("explanation", F.lit(DASH)).alias("explanation"))


def probe_feed(events: DataFrame, n: int = 15) -> DataFrame:
    return newest(events.filter(F.col("type") == "honeypot.probe"), n).select("ts_us", "seq", "ip", "port")


def raw_tail(events: DataFrame, n: int = 60) -> DataFrame:
    last = newest(events, n)
    return last.select(*NEWEST, F.to_json(F.struct(*[c for c in last.columns if c not in NEWEST])).alias("value"))


def trend(events: DataFrame, n: int = 60) -> DataFrame:
    """Running allow / alert / block counts over the last n decisions, starting from zero.

    The window sees at most n rows, so it needs no partitioning.
    """
    last = newest(events.filter(F.col("type") == "decision"), n)
    running = Window.orderBy(*NEWEST).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lambda action: F.count_if(F.col("action") == action).over(running).alias(f"{action}_total")
    return last.select(*NEWEST, counted("allow"), counted("alert"), counted("block"))


def windowed_counts(events: DataFrame, width: str, ts: str = "event_time") -> DataFrame:
    """Counts per tumbling window and action: the trend that also works on an unbounded stream."""
    return (events.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count_if(F.col("type") == "flow.features").alias("flows"),
                 F.count_if(_is_action("allow")).alias("allows"), F.count_if(_is_action("alert")).alias("alerts"),
                 F.count_if(_is_action("block")).alias("blocks"),
                 F.count_if(F.col("type") == "honeypot.probe").alias("probes"))
            .select(F.unix_micros("w.start").alias("window_us"), "flows", "allows", "alerts", "blocks", "probes"))
