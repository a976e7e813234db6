"""Queries that run the streaming jobs over the whole packet table, in slices of time, to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixtures as fx
from flowsieve.catalog import sql
from flowsieve.catalog.events import _log as event_log
from flowsieve.catalog.network import ACCEPTED_NOTES, OPTS, accepted
from flowsieve.catalog.registry import query, shared_per_input
from flowsieve.catalog.sql import with_
from flowsieve.operators import blocks as bl
from flowsieve.operators import features, notify, policy
from flowsieve.schemas import PACKETS
from flowsieve.session import scratch_path, settle
from flowsieve.sources import events, tail
from flowsieve.streaming import flows as sf
from flowsieve.streaming import kpis, late, live, probes, state

DELAY = "1 hour"
HOUR_US = 3_600_000_000
# the queries look at the blocks of a past time
KEEP_EXPIRED_US = 30 * 86_400_000_000
SLICE_US = 10 * 86_400_000_000
ROW_GROUP_BYTES = 8 << 20       # a slice's file is read by several tasks


def _slices(rows, time: str, path: str) -> None:
    """Rows as files of ten days each, written in time order; they are computed once and filtered by all tasks."""
    held = settle(rows)
    low, high = held.agg(F.min(time), F.max(time)).first()
    while low is not None and low <= high:
        held.filter(F.col(time).between(low, low + SLICE_US - 1)).repartition(1).write.mode("append") \
            .option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        low += SLICE_US


def _packet_files(spark, d: str, packets=None, end: bool = True) -> str:
    """Packets in slices of ten days, written in time order, then an end-of-input marker."""
    path = scratch_path(spark, "packets")
    rows = (fx.packets(spark, d) if packets is None else packets).select(*[F.col(f.name).cast(f.dataType) for f in PACKETS])
    _slices(rows, "ts_us", path)
    if not end:
        return path
    last = spark.read.schema(PACKETS).parquet(path)
    end = last.orderBy(F.desc("ts_us")).limit(1).withColumn("ts_us", F.unix_micros(F.lit(sf.END_OF_INPUT).cast("timestamp")))
    end.coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path: str):
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(path)


def _finish(df, spark, name: str):
    """Runs a stream to the end of its input into a table and returns the table."""
    return _finished(df, spark, name)[:2]


def _finished(df, spark, name: str):
    out = scratch_path(spark, name)
    run = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch_path(spark, "progress"))
           .trigger(availableNow=True).start(out))
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), run, out


def _flows(spark, d: str):
    return sf.assemble_stream(_stream(spark, _packet_files(spark, d, accepted(spark, d))), OPTS, DELAY)


@query("stream_filter", with_(*sql.PACKET_PARTS, select="SELECT packet_id, ts_us, src_ip, dst_ip, protocol FROM accepted"))
def stream_filter(spark, d):
    live_rows = sf.filter_stream(_stream(spark, _packet_files(spark, d)), OPTS, DELAY)
    return _finish(live_rows.select("packet_id", "ts_us", "src_ip", "dst_ip", "protocol"), spark, "accepted")[0]


@query("stream_flows", with_(*sql.FLOW_PARTS, select=f"SELECT {sql.FLOW_COLUMNS} FROM flows"))
def stream_flows(spark, d):
    return _finish(_flows(spark, d), spark, "flows")[0]


@query("stream_flows_idle", with_(*sql.PACKET_PARTS, select="""
SELECT lo, hi, protocol, min(ts_us) AS session_start, max(ts_us) AS session_end, count(*) AS packets FROM (
  SELECT *, sum(opened) OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_id) > 259200000000
      THEN 1 ELSE 0 END AS opened FROM accepted)) GROUP BY lo, hi, protocol, session"""))
def stream_flows_idle(spark, d):
    sessions = sf.idle_stream(_stream(spark, _packet_files(spark, d, accepted(spark, d))), OPTS, DELAY)
    return _finish(sessions, spark, "sessions")[0]


def _verdicts(flows):
    return policy.verdicts(fx.scores(features.extract(flows)), OPTS, fx.NOVELTY_THRESHOLD).withColumn("probe", policy.is_probe(OPTS))


@query("stream_decide", with_(*sql.DECISION_PARTS, select="SELECT flow_id, action, attacker_ip, source, round(decision_confidence, 6) AS confidence FROM decisions"))
def stream_decide(spark, d):
    decided = policy.flat(policy.decide(_verdicts(_flows(spark, d)), OPTS)).select("flow_id", "action", "attacker_ip", "source", "confidence")
    return _finish(decided, spark, "decisions")[0].withColumn("confidence", F.round("confidence", 6))


@shared_per_input
def _live(spark, d: str) -> live.Live:
    job = live.Live(spark, scratch_path(spark, "live"), OPTS, lambda flows: _verdicts(flows).drop("probe"),
                    delay_us=HOUR_US, keep_expired_us=KEEP_EXPIRED_US)
    job.start(_flows(spark, d)).awaitTermination()
    job.flush()
    return job


# in the live job a decoy contact is decided on its own, next to the decision on its flow
_LIVE = """live_rules AS (
  SELECT *, CASE WHEN src_ip IN ('10.0.0.1', '192.168.0.1') THEN 1
    WHEN syn_count >= 3 AND (bwd_packets = 0 OR rst_count = bwd_packets) THEN 3
    WHEN label = 'ANOMALY' AND confidence >= 0.9::DOUBLE THEN 4 ELSE 7 END AS rule FROM verdicts),
live_blocks AS (
  SELECT src_ip AS ip, flow_id, last_us AS blocked_at_us FROM live_rules WHERE rule IN (3, 4)
  UNION ALL SELECT src_ip, flow_id, start_us FROM live_rules WHERE probe AND rule <> 1)"""


@query("stream_blocks", with_(*sql.VERDICT_PARTS, _LIVE, select=f"""
SELECT * FROM (SELECT ip, flow_id, blocked_at_us, blocked_at_us + 172800000000 AS expires_at_us, blocked_at_us + 172800000000 - {fx.NOW_US} AS remaining_us
  FROM live_blocks QUALIFY row_number() OVER (PARTITION BY ip ORDER BY blocked_at_us DESC, flow_id DESC) = 1) WHERE remaining_us > 0"""))
def stream_blocks(spark, d):
    return bl.active(_live(spark, d).blocks.current(), fx.NOW_US).drop("reason", "source")


@query("stream_notify", with_(*sql.VERDICT_PARTS, _LIVE, """blocks AS (
  SELECT ip, flow_id, blocked_at_us, NULL AS source, NULL AS reason FROM live_blocks)""", ACCEPTED_NOTES, select="""
SELECT 'outbox' AS channel, ts_us, flow_id, ip FROM notes WHERE ok"""))
def stream_notify(spark, d):
    """The cooldown over the live job's blocks in time order; the text of messages is checked by `notify_outbox`."""
    return _live(spark, d).outbox().select("channel", "ts_us", "flow_id", "ip")


@query("stream_probes", with_(*sql.VERDICT_PARTS, _LIVE, select="""
SELECT 'honeypot.probe' AS type, flow_id, src_ip AS ip, dst_port AS port, NULL AS attacker_ip, NULL AS action FROM live_rules WHERE probe
UNION ALL SELECT 'decision', flow_id, NULL, NULL, src_ip, 'block' FROM live_rules WHERE probe AND rule <> 1"""))
def stream_probes(spark, d):
    return _live(spark, d).events().filter("source = 'honeypot' OR type = 'honeypot.probe'").select(
        "type", "flow_id", "ip", "port", "attacker_ip", "action")


@query("stream_eventlog", with_(*sql.VERDICT_PARTS, select="""
SELECT type, count(*) AS records, count(DISTINCT flow_id) AS flows FROM (
  SELECT unnest(['flow.features', 'decision', 'verdict']) AS type, flow_id FROM verdicts
  UNION ALL SELECT unnest(['honeypot.probe', 'decision', 'verdict']), flow_id FROM verdicts WHERE probe) GROUP BY type"""))
def stream_eventlog(spark, d):
    """The log the live job wrote, followed as a stream."""
    job = _live(spark, d)
    rows = live.tail_events(spark, f"{job.folder}/events/*/*/*").select("type", "flow_id")
    return _finish(rows, spark, "tail")[0].groupBy("type").agg(F.count("*").alias("records"), F.count_distinct("flow_id").alias("flows"))


# a flow still to come starts at most this long before the newest end: the packets come in slices of ten days
_HOLD = f"{(HOUR_US + OPTS.active_us + SLICE_US) // 1_000_000 + 1} seconds"


@query("stream_kpis", with_(*sql.DECISION_PARTS, select="""
SELECT ts_us - ts_us % 21600000000 AS window_us, 0 AS flows, count(*) FILTER (action = 'allow') AS allows, count(*) FILTER (action = 'alert') AS alerts,
  count(*) FILTER (action = 'block') AS blocks, 0 AS probes FROM decisions GROUP BY 1"""))
def stream_kpis(spark, d):
    """Tumbling windows counted inside the stream of decisions, upserted batch by batch."""
    decided = policy.flat(policy.decide(_verdicts(_flows(spark, d)), OPTS))
    actions = _finish(decided.select(F.lit("decision").alias("type"), "action", F.col("last_us").alias("ts_us")), spark, "actions")[0]
    path = scratch_path(spark, "actions")
    _slices(actions, "ts_us", path)
    rows = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(path)
    counts = kpis.LiveCounts(spark, scratch_path(spark, "kpis"))
    counts.start(rows.withColumn("event_time", F.timestamp_micros("ts_us")), "6 hours", _HOLD).awaitTermination()
    return counts.current()


@shared_per_input
def _requests(spark, d: str) -> str:
    """Block rows of the completed flows and of their decoy contacts, in files that end with an end-of-input marker."""
    flows, _, path = _finished(_flows(spark, d), spark, "flows")
    stream = spark.readStream.schema(flows.schema).parquet(path)
    decided = policy.decide(_verdicts(stream).drop("probe"), OPTS)
    probed = policy.decide(policy.probe_verdicts(policy.probe_events(decided, OPTS)), OPTS)
    columns = ["flow_id", "ts_us", "action", "attacker_ip", "reason", "confidence", "source"]
    flat = policy.flat(decided.withColumn("ts_us", F.col("last_us"))).select(*columns).unionByName(policy.flat(probed).select(*columns))
    made = bl.blocks_from_decisions(flat, OPTS)
    rows, out = _finish(made, spark, "requests")[0], scratch_path(spark, "requests")
    _slices(rows, "blocked_at_us", out)         # in time order: a file of all times would move the watermark past the next ones
    end = rows.limit(1).withColumn("blocked_at_us", F.unix_micros(F.lit(sf.END_OF_INPUT).cast("timestamp")))
    end.coalesce(1).write.mode("append").parquet(out)
    return out


def _block_rows(spark, d: str):
    columns = "ip string, flow_id bigint, blocked_at_us bigint, expires_at_us bigint, reason string, source string"
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(_requests(spark, d))


@query("stream_block_state", with_(*sql.VERDICT_PARTS, _LIVE, select="""
SELECT ip, flow_id, blocked_at_us, blocked_at_us + 172800000000 AS expires_at_us, 1 AS expiries FROM live_blocks
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY blocked_at_us DESC, flow_id DESC) = 1"""))
def stream_block_state(spark, d):
    """The block list as keyed state: its change log ends with the expiry of every address's last block."""
    changes = _finish(state.block_changes(state.operations(_block_rows(spark, d)), _HOLD), spark, "changes")[0]
    last = changes.groupBy("ip").agg(
        F.max("at_us").alias("at_us"), F.max_by("change", F.struct("at_us", F.col("change") == "expire")).alias("change"))
    gone = changes.filter("change = 'expire'").join(last.filter("change = 'expire'"), ["ip", "at_us"])
    ended = gone.groupBy("ip", "expires_at_us").agg(F.count("*").alias("expiries"))
    return state.standing(changes, 0).join(ended, ["ip", "expires_at_us"], "left").select("ip", "flow_id", "blocked_at_us", "expires_at_us", "expiries")


@query("stream_cooldown", with_(*sql.VERDICT_PARTS, _LIVE, """blocks AS (
  SELECT ip, flow_id, blocked_at_us, NULL AS source, NULL AS reason FROM live_blocks)""", ACCEPTED_NOTES, select="""
SELECT 'outbox' AS channel, ts_us, flow_id, ip FROM notes WHERE ok"""))
def stream_cooldown(spark, d):
    """The cooldown as keyed state of its channel."""
    asked = notify.requests(_block_rows(spark, d), OPTS)
    return _finish(state.accepted_stream(asked, OPTS, _HOLD), spark, "accepted")[0].select("channel", "ts_us", "flow_id", "ip")


@query("stream_early_probes", with_(*sql.PACKET_PARTS, select="""
SELECT DISTINCT src_ip AS attacker_ip, CASE WHEN src_ip IN ('10.0.0.1', '192.168.0.1') THEN 'allow' ELSE 'block' END AS action
FROM accepted WHERE protocol = 6 AND dst_port = 2323 AND tcp_flags & 18 = 2"""))
def stream_early_probes(spark, d):
    """Decoy contacts decided at their first packet."""
    stream = _stream(spark, _packet_files(spark, d, accepted(spark, d)))
    return _finish(probes.early_decisions(stream, OPTS, DELAY), spark, "early")[0].select("attacker_ip", "action").distinct()


def _split(spark, d: str) -> late.Splitter:
    """Every 50th packet arrives after the others; those behind the watermark go to quarantine."""
    rows = accepted(spark, d)
    path = _packet_files(spark, d, rows.filter("packet_id % 50 <> 0"), end=False)
    behind = rows.filter("packet_id % 50 = 0").select(*[F.col(f.name).cast(f.dataType) for f in PACKETS])
    behind.repartition(4, "packet_id").write.mode("append").parquet(path)
    splitter = late.Splitter(spark, scratch_path(spark, "split"), HOUR_US)
    splitter.start(_stream(spark, path)).awaitTermination()
    return splitter


@query("stream_quarantine", with_(*sql.PACKET_PARTS, select="""
SELECT packet_id, ts_us, packet_id % 50 = 0 AND ts_us <= (SELECT max(ts_us) FROM accepted WHERE packet_id % 50 <> 0) // 1000 * 1000 - 3600000000 AS late
FROM accepted"""))
def stream_quarantine(spark, d):
    splitter = _split(spark, d)
    rows = [t.select("packet_id", "ts_us", F.lit(is_late).alias("late")) for t, is_late in ((splitter.on_time(), False), (splitter.quarantine(), True))]
    return rows[0].unionByName(rows[1])


@query("late_packets")
def late_packets(spark, d):
    """Packets in flows and in quarantine when every 50th packet arrives after the others."""
    splitter = _split(spark, d)
    table, _ = _finish(sf.assemble_stream(_with_end(spark, splitter), OPTS, DELAY), spark, "flows")
    return table.agg(F.sum(F.col("fwd_packets") + F.col("bwd_packets")).alias("packets_in_flows")).crossJoin(
        splitter.quarantine().agg(F.count("*").alias("packets_dropped")))


def _with_end(spark, splitter: late.Splitter):
    """The on-time packets as a stream, then an end-of-input marker."""
    end = splitter.on_time().limit(1).withColumn("ts_us", F.unix_micros(F.lit(sf.END_OF_INPUT).cast("timestamp")))
    end.coalesce(1).write.parquet(f"{splitter.folder}/rows/batch={live.LAST_BATCH}/late=false")
    return splitter.on_time_stream()


@query("stream_log_lines", with_(*sql.LOG_PARTS, select="SELECT type, count(*) AS records, count(protocol) AS with_flow FROM log GROUP BY type"))
def stream_log_lines(spark, d):
    """The event log as text files, followed by byte offsets in small pieces."""
    path = scratch_path(spark, "lines")
    events.encode(event_log(spark, d).drop("ts_us", "seq")).select("value").write.text(path)
    spark.dataSource.register(tail.LogTail)
    lines = spark.readStream.format("log_tail").option("glob", "part-*").option("bytesPerPartition", 1 << 18).load(path)
    rows = _finish(events.decode(lines).select("type", F.col("flow").isNotNull().alias("has_flow")), spark, "followed")[0]
    return rows.groupBy("type").agg(F.count("*").alias("records"), F.count_if("has_flow").alias("with_flow"))
