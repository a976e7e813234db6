"""Display expressions for packets, flows, verdicts and notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol numbers and names.
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6"}
# Flag bits in display order.
FLAG_LETTERS = [(0x01, "F"), (0x02, "S"), (0x04, "R"), (0x10, "A")]
DASH = "—"
ARROW = "→"


def has_bit(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def protocol_name(protocol: Column, otherwise: Column, names: dict[int, str] = PROTOCOLS) -> Column:
    chosen = None
    for number, name in names.items():
        chosen = (F if chosen is None else chosen).when(protocol == number, F.lit(name))
    return chosen.otherwise(otherwise)


def packet_protocol(protocol: Column) -> Column:
    return protocol_name(protocol, F.concat(F.lit("IPPROTO_"), protocol.cast("string")))


def flow_protocol(protocol: Column) -> Column:
    return protocol_name(protocol, protocol.cast("string"))


def feed_protocol(protocol: Column) -> Column:
    number = F.when(protocol != 0, protocol.cast("string"))
    return protocol_name(protocol, F.coalesce(number, F.lit(DASH)), {6: "TCP", 17: "UDP"})


def flag_text(protocol: Column, flags: Column, icmp_type: Column) -> Column:
    letters = F.concat(*[F.when(has_bit(flags, bit), F.lit(letter)).otherwise(F.lit(""))
                         for bit, letter in FLAG_LETTERS])
    return (F.when(protocol == 6, letters)
            .when(protocol.isin(1, 58), F.concat(F.lit("type="), icmp_type.cast("string")))
            .otherwise(F.lit("")))


def endpoint(ip: Column, port: Column) -> Column:
    return F.when(port == 0, ip).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def packet_text(protocol: Column, src: Column, dst: Column, flags: Column, l4_len: Column) -> Column:
    """`TCP  a:1 -> b:2 [SA] 10B`; the protocol name is padded to four places, never cut."""
    name = packet_protocol(protocol)
    padded = F.when(F.length(name) < 4, F.rpad(name, 4, " ")).otherwise(name)
    return F.concat(padded, F.lit(" "), src, F.lit(" -> "), dst, F.lit(" ["), flags, F.lit("] "),
                    l4_len.cast("string"), F.lit("B"))


def flow_text() -> Column:
    src = endpoint(F.col("src_ip"), F.col("src_port"))
    dst = endpoint(F.col("dst_ip"), F.col("dst_port"))
    seconds = F.greatest(F.lit(0), F.col("last_us") - F.col("start_us")) / F.lit(1e6)
    return F.concat(
        F.lit("flow "), flow_protocol(F.col("protocol")), F.lit(" "), src, F.lit(" -> "), dst,
        F.format_string("  fwd=%dp/%dB bwd=%dp/%dB  ", "fwd_packets", "fwd_bytes", "bwd_packets", "bwd_bytes"),
        F.format_string("syn=%d ack=%d fin=%d rst=%d  ", "syn_count", "ack_count", "fin_count", "rst_count"),
        F.format_string("dur=%.2fs", seconds))


def notification_text(ip: Column, reason: Column, source: Column, ts: Column) -> Column:
    """Lines of a block notification; empty parts are left out."""
    when = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    blank = F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**IP BLOCKED:** "), ip),
        F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("Reason: "), reason)).otherwise(blank),
        F.concat(F.lit("Source: "), F.concat_ws(" | ", F.nullif(source, F.lit("")), when)))


def general_number(value: Column) -> Column:
    """Number text with six significant digits and no trailing zeros, like C's %g."""
    rounded = F.format_string("%.5e", value)
    exponent = F.regexp_extract(rounded, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(rounded, r"^([^e]+)e", 1), r"\.?0+$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
                          F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.coalesce(*[F.when(exponent == e, F.format_string(f"%.{5 - e}f", value))
                         for e in range(-4, 6)])
    trimmed = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return (F.when(value == 0, F.lit("0"))
            .when((exponent < -4) | (exponent >= 6), scientific)
            .otherwise(trimmed))


def shown(value: Column, digits: int = 4) -> Column:
    """Table cell: dash for null, whole numbers as they are, others with fixed digits."""
    return (F.when(value.isNull(), F.lit(DASH))
            .when(value == F.floor(value), F.floor(value).cast("string"))
            .otherwise(F.format_string(f"%.{digits}f", value)))


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))


def shown_time(seconds: Column) -> Column:
    """Clock time in the session's zone of a time in seconds; dash where there is none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.nullif(seconds, F.lit(0.0))), "HH:mm:ss"), F.lit(DASH))
