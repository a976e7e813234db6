"""Packet selection: noise, protocol and port filters, and the funnel that counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.addresses import is_noise
from flowsieve.options import Options

TRANSPORT = [6, 17]
CONTROL = [1, 58]


def valid_ports() -> Column:
    return (F.col("src_port") >= 0) & (F.col("dst_port") >= 0)


def captured(opts: Options) -> Column:
    protocols = TRANSPORT + (CONTROL if opts.include_icmp else [])
    keep = valid_ports() & F.col("protocol").isin(protocols)
    if opts.port_allowlist:
        keep = keep & (F.col("src_port").isin(opts.port_allowlist) | F.col("dst_port").isin(opts.port_allowlist))
    return F.coalesce(keep, F.lit(False))


def drop_noise(packets: DataFrame, opts: Options) -> DataFrame:
    return packets.filter(~is_noise(opts.drop_link_local))


def capture_filter(packets: DataFrame, opts: Options) -> DataFrame:
    return packets.filter(captured(opts))


def port_table_filter(packets: DataFrame, ports: DataFrame, column: str = "port") -> DataFrame:
    """Allow-list held as a table; an empty table means no restriction.

    A port is a 16-bit number, so the distinct list never has more than 65,536 rows to broadcast.
    """
    listed = ports.select(F.col(column).cast("int").alias("port")).filter("port BETWEEN 0 AND 65535").distinct()
    if listed.isEmpty():
        return packets
    side = lambda end: F.broadcast(listed.select(F.col("port").alias(f"{end}_port"), F.lit(True).alias(f"{end}_hit")))
    return (packets.join(side("src"), "src_port", "left").join(side("dst"), "dst_port", "left")
            .filter("src_hit OR dst_hit").select(*packets.columns))


def accept(packets: DataFrame, opts: Options) -> DataFrame:
    """Packets that reach flow assembly; narrow and stateless, so it also runs on a stream.

    The number comparisons come first, so that the text patterns see fewer rows.
    """
    return drop_noise(capture_filter(packets, opts), opts)


def capture_funnel(decoded: DataFrame, opts: Options, error: str = "parse_error") -> DataFrame:
    """Counters per interface; noise is tested before the capture filter."""
    fate = (F.when(F.col(error).isNotNull(), "error").when(is_noise(opts.drop_link_local), "noise")
            .when(captured(opts), "accepted").otherwise("filtered"))
    count = lambda *fates: F.count_if(F.col("fate").isin(*fates))
    return decoded.select("iface", fate.alias("fate")).groupBy("iface").agg(
        F.count("*").alias("frames_received"),
        count("error").alias("parse_errors"),
        count("noise", "filtered", "accepted").alias("parsed"),
        count("noise").alias("noise"),
        count("filtered").alias("filtered"),
        count("accepted").alias("accepted"))
