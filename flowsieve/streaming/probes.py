"""Decoy contacts on a packet stream, decided when their first packet comes and not when their flow ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.text import has_bit
from flowsieve.operators import policy
from flowsieve.options import Options
from flowsieve.streaming.flows import before_end, event_time

SYN, ACK = 0x02, 0x10
CONTACT = ["src_ip", "src_port", "dst_ip", "dst_port"]
DECIDED = ["flow_id", "ts_us", "action", "attacker_ip", "reason", "confidence", "source"]


def early_probes(packets: DataFrame, opts: Options, delay: str) -> DataFrame:
    """Probe events (flow_id, ts_us, ip, port) of the packets that open a contact with a decoy port.

    That is a SYN without ACK, or with `honeypot_require_ack` the first ACK of a handshake. Repeats of a contact within the
    delay of its first packet are one event; `flow_id` is the packet's id, as for flows.
    """
    flags = F.col("tcp_flags")
    opens = has_bit(flags, ACK) & ~has_bit(flags, SYN) if opts.honeypot_require_ack else has_bit(flags, SYN) & ~has_bit(flags, ACK)
    hit = F.lit(opts.block_honeypot_enabled) & (F.col("protocol") == 6) & F.col("dst_port").isin(opts.honeypot_ports) & opens
    # the condition reads the event time, so it stays above the watermark, which all packets move
    timely = F.when(F.col("event_time").isNotNull(), hit)
    first = event_time(packets, delay).filter(before_end()).filter(timely).dropDuplicatesWithinWatermark(CONTACT)
    return first.select(F.col("packet_id").alias("flow_id"), "ts_us", F.col("src_ip").alias("ip"), F.col("dst_port").alias("port"))


def early_decisions(packets: DataFrame, opts: Options, delay: str) -> DataFrame:
    """The decisions on decoy contacts, one micro-batch after their packet at most."""
    return policy.flat(policy.decide(policy.probe_verdicts(early_probes(packets, opts, delay)), opts)).select(*DECIDED)


def united(flow_decisions: DataFrame, packets: DataFrame, opts: Options, delay: str) -> DataFrame:
    """Decisions on flows and early ones on decoy contacts as one stream; the slower watermark of both holds."""
    return flow_decisions.select(*DECIDED).unionByName(early_decisions(packets, opts, delay))
