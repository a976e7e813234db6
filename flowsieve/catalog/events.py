"""Queries on the event log and the dashboard views over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.catalog import sql
from flowsieve.catalog.network import OPTS, decided_rows, six
from flowsieve.catalog.registry import query
from flowsieve.catalog.sql import with_
from flowsieve.operators import policy, views
from flowsieve.session import scratch_path, settle
from flowsieve.sources import events as ev

# order of the record kinds of one flow in the log: a decision is logged before its verdict
KINDS = {"flow.features": 0, "honeypot.probe": 1, "decision": 2, "verdict": 3}


def _log(spark, d: str, encoded: bool = False) -> DataFrame:
    decided = settle(decided_rows(spark, d))
    rank = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("type")]
    return (ev.union(ev.feature_events(decided), ev.probe_log_events(policy.probe_events(decided, OPTS)),
                     ev.decision_events(decided), ev.verdict_events(decided))
            .withColumns({"ts_us": F.round(F.col("ts") * 1e6).cast("bigint"), "seq": F.col("flow_id") * 4 + rank}))


def _lines(spark, d: str) -> DataFrame:
    """The log as text; every 50th line is cut off in the middle."""
    log = _log(spark, d)
    line = F.to_json(F.struct(*[c for c in log.columns if c not in ("ts_us", "seq")]))
    cut = F.when(F.col("seq") % 50 == 0, F.left(line, F.length(line) - 10)).otherwise(line)
    return log.select("ts_us", "seq", cut.alias("value"))


_SHOWN = "type, layer, flow_id, label, action, attacker_ip, source, ip, port, round(confidence, 6) AS confidence, novelty, src_ip, dst_port"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("ts_us", "seq", "type", "layer", "flow_id", "label", "action", "attacker_ip", "source", "ip", "port",
                     six("confidence"), "novelty", F.col("flow.src_ip").alias("src_ip"), F.col("flow.dst_port").alias("dst_port"))


@query("eventlog_union", with_(*sql.LOG_PARTS, select=f"SELECT ts_us, seq, {_SHOWN} FROM log"))
def eventlog_union(spark, d):
    return _shown(_log(spark, d))


@query("eventlog_encode", with_(*sql.LOG_PARTS, select="SELECT type, count(*) AS records, count(protocol) AS with_flow FROM log GROUP BY type"))
def eventlog_encode(spark, d):
    """Appended as text partitioned by type and day, and counted after reading the files back."""
    path = scratch_path(spark, "eventlog")
    ev.append(_log(spark, d).drop("ts_us", "seq"), path)
    return ev.scan(spark, path).groupBy("type").agg(F.count("*").alias("records"), F.count("flow").alias("with_flow"))


@query("eventlog_scan", with_(*sql.LOG_PARTS, select=f"SELECT ts_us, seq, {_SHOWN} FROM log WHERE seq % 50 <> 0"))
def eventlog_scan(spark, d):
    return _shown(ev.decode(_lines(spark, d), keep=["ts_us", "seq"]))


@query("events_recent", with_(*sql.LOG_PARTS, select=f"SELECT ts_us, seq, {_SHOWN} FROM (SELECT * FROM log ORDER BY ts_us DESC, seq DESC LIMIT 100) WHERE seq % 50 <> 0"))
def events_recent(spark, d):
    return _shown(ev.recent(_lines(spark, d), 100, ["ts_us", "seq"]))


@query("log_tail", with_(*sql.LOG_PARTS, select="SELECT ts_us, seq, type, layer, action, ip FROM log ORDER BY ts_us DESC, seq DESC LIMIT 60"))
def log_tail(spark, d):
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return views.raw_tail(_log(spark, d)).select("ts_us", "seq", *[field(n) for n in ("type", "layer", "action", "ip")])


@query("kpi_counts", with_(*sql.LOG_PARTS, select="""
SELECT count(*) FILTER (type = 'flow.features') AS flows, count(DISTINCT CASE WHEN type = 'verdict' THEN flow_id END) AS verdict_flows,
  count(*) FILTER (action = 'alert') AS alerts, count(*) FILTER (action = 'block') AS blocks, count(*) FILTER (type = 'honeypot.probe') AS probes
FROM (SELECT * FROM log ORDER BY ts_us DESC, seq DESC LIMIT 2000)"""))
def kpi_counts(spark, d):
    return views.kpi_counts(_log(spark, d))


@query("feed_latest", with_(*sql.LOG_PARTS, select="""
SELECT ts_us, seq, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS protocol_name,
  concat(src_ip, ':', src_port, ' → ', dst_ip, ':', dst_port) AS endpoint, label, round(confidence, 6) AS confidence, novelty, action, attacker_ip,
  CASE WHEN source = 'model' THEN regexp_replace(reason, '[0-9]+[.][0-9]+', '#', 'g') ELSE reason END AS reason, '—' AS explanation
FROM log WHERE type = 'decision' ORDER BY ts_us DESC, seq DESC LIMIT 40"""))
def feed_latest(spark, d):
    rows = views.feed(_log(spark, d))
    model = F.col("reason").rlike("confidence")
    return rows.withColumns({"confidence": F.round("confidence", 6), "reason": F.when(
        model, F.regexp_replace("reason", r"[0-9]+[.][0-9]+", "#")).otherwise(F.col("reason"))})


@query("probes_latest", with_(*sql.LOG_PARTS, select="SELECT ts_us, seq, ip, port FROM log WHERE type = 'honeypot.probe' ORDER BY ts_us DESC, seq DESC LIMIT 15"))
def probes_latest(spark, d):
    return views.probe_feed(_log(spark, d))


@query("trend_cumulative", with_(*sql.LOG_PARTS, select="""
SELECT ts_us, seq, count(*) FILTER (action = 'allow') OVER w AS allow_total, count(*) FILTER (action = 'alert') OVER w AS alert_total,
  count(*) FILTER (action = 'block') OVER w AS block_total
FROM (SELECT * FROM log WHERE type = 'decision' ORDER BY ts_us DESC, seq DESC LIMIT 60) WINDOW w AS (ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)"""))
def trend_cumulative(spark, d):
    return views.trend(_log(spark, d))


@query("kpi_windowed", with_(*sql.LOG_PARTS, select="""
SELECT ts_us - ts_us % 21600000000 AS window_us, count(*) FILTER (type = 'flow.features') AS flows, count(*) FILTER (action = 'allow') AS allows,
  count(*) FILTER (action = 'alert') AS alerts, count(*) FILTER (action = 'block') AS blocks, count(*) FILTER (type = 'honeypot.probe') AS probes
FROM log GROUP BY 1"""))
def kpi_windowed(spark, d):
    log = _log(spark, d).withColumn("event_time", F.timestamp_micros("ts_us"))
    return views.windowed_counts(log, "6 hours")
