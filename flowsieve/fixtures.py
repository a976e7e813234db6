"""Packets, scores and a labelled corpus derived from the driver's tables, as Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.options import Options

DAY = 86_400
# query parameters that make both timeouts, the flood rule and the block life-cycle visible
OPTIONS = Options(flow_idle_timeout=3 * DAY, flow_active_timeout=10 * DAY, syn_flood_minimum=3,
                  whitelist=["10.0.0.1", "192.168.0.1"], block_timeout=2 * DAY, notify_cooldown=6 * 3600,
                  notify_channel="outbox", prevent_mode=True, tick_seconds=DAY)
NOW_US = 1_705_708_800_000_000  # 2024-01-20T00:00:00Z
NOVELTY_THRESHOLD = -0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network packets read out of the click-stream events."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us", "value",
        "concat('10.0.', CAST(floor(user_id / 250) AS BIGINT), '.', user_id % 250 + 1) AS cip",
        "concat('192.168.0.', user_id % 7 + 1) AS sip",
        "CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 1 "
        "ELSE 6 END AS protocol",
        "CAST(30000 + user_id % 20000 AS INT) AS cport",
        "CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080 "
        "WHEN 'signup' THEN 2323 ELSE 53 END AS sport",
        "event_id % 3 = 2 AS rev")
    return base.selectExpr(
        "event_id AS packet_id", "ts_us", "protocol",
        "CASE WHEN event_id % 89 = 0 THEN '169.254.1.1' WHEN rev THEN sip ELSE cip END AS src_ip",
        "CASE WHEN event_id % 97 = 0 THEN '224.0.0.251' WHEN rev THEN cip ELSE sip END AS dst_ip",
        "CASE WHEN protocol = 1 THEN 0 WHEN event_id % 83 = 0 THEN -1 WHEN rev THEN sport ELSE cport END AS src_port",
        "CASE WHEN protocol = 1 THEN 0 WHEN event_id % 83 = 0 THEN -1 WHEN rev THEN cport ELSE sport END AS dst_port",
        "CASE WHEN protocol <> 6 THEN 0 ELSE CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 16 "
        "WHEN 3 THEN 16 WHEN 4 THEN 17 WHEN 5 THEN 4 ELSE 24 END END AS tcp_flags",
        "40 + CAST(floor(value * 10) AS BIGINT) AS size")


def scores(flows: DataFrame) -> DataFrame:
    """Arithmetic stand-in for model output: class probabilities and a novelty score per flow."""
    p = "CAST((fwd_bytes + 3 * bwd_bytes + dst_port) % 101 AS DOUBLE) / 100"
    return flows.withColumns({
        "probability": F.expr(f"array({p}, 1 - {p})"),
        "anomaly_score": F.expr("CAST((7 * fwd_bytes + bwd_bytes) % 1000 AS DOUBLE) / 1000 - 0.3D")})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled flow corpus read out of the order lines; one 'file' per ship year."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS row_id",
        "(l_orderkey * 48271 + l_linenumber * 16807 + l_partkey * 69621 + l_suppkey * 39373"
        " + CAST(l_quantity AS BIGINT)) % 2147483647 AS draw",
        "concat('year_', year(l_shipdate), '.csv') AS source_file",
        "CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE l_tax * 100 END AS flow_duration",
        "CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS protocol",
        "l_partkey % 1024 AS destination_port",
        "CAST(l_quantity AS BIGINT) AS forward_packet_count",
        "CAST(l_linenumber AS BIGINT) AS backward_packet_count",
        "CAST(floor(l_extendedprice) AS BIGINT) AS forward_bytes",
        "CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS backward_bytes",
        "CASE WHEN l_tax = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (l_quantity + l_linenumber) / (l_tax * 100) END"
        " AS packets_per_second",
        "CASE WHEN l_returnflag = 'R' AND l_partkey % 10 < 8 THEN 50 + CAST(l_quantity AS BIGINT)"
        " ELSE CAST(l_quantity AS BIGINT) % 3 END AS syn_count",
        "CAST(l_quantity AS BIGINT) % 20 AS ack_count",
        "CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN l_linenumber ELSE 0 END AS rst_count",
        "CASE WHEN l_returnflag = 'R' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'DDoS' ELSE 'PortScan' END)"
        " WHEN l_returnflag = 'A' THEN ' benign ' ELSE 'BENIGN' END AS Label")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as raw frames: some with VLAN tags, some IPv6, some too short or of another kind."""
    number = lambda expr, digits: f"lpad(hex(CAST({expr} AS BIGINT)), {digits}, '0')"
    v4 = lambda c: "concat(" + ", ".join(number(f"split({c}, '[.]')[{i}]", 2) for i in range(4)) + ")"
    v6 = lambda c: f"concat('20010DB8', repeat('0', 20), {number(c, 4)})"
    ports = f"concat({number('src_port', 4)}, {number('dst_port', 4)})"
    l4 = (f"CASE WHEN protocol = 1 THEN '08000000' WHEN src_port < 0 THEN '0102' WHEN protocol = 17 THEN "
          f"concat({ports}, '00080000', repeat('AA', CAST(size % 7 AS INT))) ELSE "
          f"concat({ports}, '0000000100000000', '50', {number('tcp_flags', 2)}, '200000000000', repeat('BB', CAST(size % 5 AS INT))) END")
    ip4 = (f"concat('4500', {number('size', 4)}, '0001400040', {number('protocol', 2)}, '0000', {v4('src_ip')}, {v4('dst_ip')}, l4)")
    ip6 = (f"concat('60000000', {number('size - 40', 4)}, {number('protocol', 2)}, '40', {v6('packet_id % 60000 + 1')}, {v6('7')}, l4)")
    link = "concat('001122334455', '66778899AABB', CASE WHEN packet_id % 4 = 1 THEN '81000064' ELSE '' END, "
    rows = packets(spark, sf_dir).withColumn("l4", F.expr(l4))
    body = (f"CASE WHEN packet_id % 101 = 0 THEN '00112233' WHEN packet_id % 103 = 0 THEN {link}'0806', '0001') "
            f"WHEN packet_id % 10 = 3 THEN {link}'86DD', {ip6}) ELSE {link}'0800', {ip4}) END")
    return rows.selectExpr("packet_id AS frame_id", "concat('if', packet_id % 3) AS iface",
                           "timestamp_micros(ts_us) AS ts", f"unhex({body}) AS frame")
