"""SQL building blocks (DuckDB dialect) for the tables that the queries derive from the driver data."""

PACKETS = """packets AS (
SELECT event_id AS packet_id, ts_us, protocol,
  CASE WHEN event_id % 89 = 0 THEN '169.254.1.1' WHEN rev THEN sip ELSE cip END AS src_ip,
  CASE WHEN event_id % 97 = 0 THEN '224.0.0.251' WHEN rev THEN cip ELSE sip END AS dst_ip,
  CASE WHEN protocol = 1 THEN 0 WHEN event_id % 83 = 0 THEN -1 WHEN rev THEN sport ELSE cport END AS src_port,
  CASE WHEN protocol = 1 THEN 0 WHEN event_id % 83 = 0 THEN -1 WHEN rev THEN cport ELSE sport END AS dst_port,
  CASE WHEN protocol <> 6 THEN 0 ELSE CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 16
       WHEN 3 THEN 16 WHEN 4 THEN 17 WHEN 5 THEN 4 ELSE 24 END END AS tcp_flags,
  40 + CAST(floor(value * 10) AS BIGINT) AS size
FROM (SELECT event_id, epoch_us(ts) AS ts_us, value,
        concat('10.0.', CAST(floor(user_id / 250) AS BIGINT), '.', user_id % 250 + 1) AS cip,
        concat('192.168.0.', user_id % 7 + 1) AS sip,
        CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 1 ELSE 6 END AS protocol,
        CAST(30000 + user_id % 20000 AS INTEGER) AS cport,
        CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080
             WHEN 'signup' THEN 2323 ELSE 53 END AS sport,
        event_id % 3 = 2 AS rev
      FROM events) b)"""

NOISE = ("(src_ip LIKE '169.254.%' OR dst_ip LIKE '169.254.%' OR src_ip LIKE '224.%' OR dst_ip LIKE '224.%')")
CAPTURED = "(src_port >= 0 AND dst_port >= 0 AND protocol IN (6, 17))"

ACCEPTED = f"""accepted AS (
SELECT *, least(concat(src_ip, '|', src_port), concat(dst_ip, '|', dst_port)) AS lo,
       greatest(concat(src_ip, '|', src_port), concat(dst_ip, '|', dst_port)) AS hi
FROM packets WHERE {CAPTURED} AND NOT {NOISE})"""


def segments(idle: int = 259200000000, active: int | None = 864000000000) -> str:
    cut = f"o.ts_us - r.ts_us > {idle}" + (f" OR o.ts_us - r.seg_start > {active}" if active else "")
    return f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_id) AS rn FROM accepted),
chained AS (
  SELECT lo, hi, protocol, rn, packet_id, ts_us, ts_us AS seg_start FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.lo, o.hi, o.protocol, o.rn, o.packet_id, o.ts_us, CASE WHEN {cut} THEN o.ts_us ELSE r.seg_start END
  FROM chained r JOIN ordered o ON o.lo = r.lo AND o.hi = r.hi AND o.protocol = r.protocol AND o.rn = r.rn + 1)"""


FLOWS = """placed AS (
  SELECT a.*, c.seg_start, first_value(a.packet_id) OVER w AS flow_id,
    first_value(a.src_ip) OVER w AS f_src, first_value(a.dst_ip) OVER w AS f_dst,
    first_value(a.src_port) OVER w AS f_sport, first_value(a.dst_port) OVER w AS f_dport
  FROM accepted a JOIN chained c USING (packet_id)
  WINDOW w AS (PARTITION BY a.lo, a.hi, a.protocol, c.seg_start ORDER BY a.ts_us, a.packet_id)),
directed AS (SELECT *, src_ip = f_src AND src_port = f_sport AS fwd FROM placed),
flows AS (
  SELECT flow_id, protocol, f_src AS src_ip, f_dst AS dst_ip, f_sport AS src_port, f_dport AS dst_port,
    min(ts_us) AS start_us, max(ts_us) AS last_us,
    count(*) FILTER (fwd) AS fwd_packets, count(*) FILTER (NOT fwd) AS bwd_packets,
    CAST(sum(CASE WHEN fwd THEN size ELSE 0 END) AS BIGINT) AS fwd_bytes,
    CAST(sum(CASE WHEN fwd THEN 0 ELSE size END) AS BIGINT) AS bwd_bytes,
    count(*) FILTER (protocol = 6 AND tcp_flags & 2 <> 0) AS syn_count,
    count(*) FILTER (protocol = 6 AND tcp_flags & 16 <> 0) AS ack_count,
    count(*) FILTER (protocol = 6 AND tcp_flags & 1 <> 0) AS fin_count,
    count(*) FILTER (protocol = 6 AND tcp_flags & 4 <> 0) AS rst_count
  FROM directed GROUP BY ALL)"""
FLOW_COLUMNS = ("flow_id, protocol, src_ip, dst_ip, src_port, dst_port, start_us, last_us, fwd_packets, bwd_packets, "
                "fwd_bytes, bwd_bytes, syn_count, ack_count, fin_count, rst_count")

FEATURES = """features AS (
  SELECT *, (last_us - start_us) / 1e6 AS flow_duration, fwd_packets AS total_fwd_packets,
    bwd_packets AS total_bwd_packets, fwd_bytes AS total_fwd_bytes, bwd_bytes AS total_bwd_bytes,
    (fwd_packets + bwd_packets) / CASE WHEN last_us - start_us > 1 THEN (last_us - start_us) / 1e6 ELSE 1e-6 END
      AS packets_per_second
  FROM flows)"""

SCORED = """raw_scores AS (
  SELECT *, CAST((fwd_bytes + 3 * bwd_bytes + dst_port) % 101 AS DOUBLE) / 100 AS p_anomaly,
    CAST((7 * fwd_bytes + bwd_bytes) % 1000 AS DOUBLE) / 1000 - CAST(0.3 AS DOUBLE) AS anomaly_score FROM features),
scored AS (
  SELECT *, 1 - p_anomaly AS benign_probability,
    CASE WHEN p_anomaly >= 1 - p_anomaly THEN 'ANOMALY' ELSE 'BENIGN' END AS label,
    greatest(p_anomaly, 1 - p_anomaly) AS confidence, anomaly_score < CAST(-0.25 AS DOUBLE) AS novelty FROM raw_scores),
verdicts AS (
  SELECT *, (label = 'ANOMALY' AND confidence >= 0.5::DOUBLE) OR novelty AS alert,
    protocol = 6 AND dst_port = 2323 AS probe FROM scored)"""

DECIDED = """ruled AS (
  SELECT *, CASE
    WHEN src_ip IN ('10.0.0.1', '192.168.0.1') THEN 1
    WHEN probe THEN 2
    WHEN syn_count >= 3 AND (bwd_packets = 0 OR rst_count = bwd_packets) THEN 3
    WHEN label = 'ANOMALY' AND confidence >= 0.9::DOUBLE THEN 4
    WHEN alert AND novelty THEN 5 WHEN alert THEN 6 ELSE 7 END AS rule FROM verdicts),
decisions AS (
  SELECT *, last_us AS ts_us, src_ip AS attacker_ip,
    CASE WHEN rule IN (1, 7) THEN 'allow' WHEN rule IN (2, 3, 4) THEN 'block' ELSE 'alert' END AS action,
    CASE rule WHEN 1 THEN 'whitelist' WHEN 2 THEN 'honeypot' WHEN 3 THEN 'rule' WHEN 5 THEN 'novelty' ELSE 'model' END AS source,
    CASE WHEN rule IN (2, 3) THEN 1.0::DOUBLE ELSE confidence END AS decision_confidence,
    CASE rule WHEN 1 THEN 'whitelisted host - never blocked'
      WHEN 2 THEN 'honeypot probe - no real service should be contacted'
      WHEN 3 THEN concat('SYN flood (', syn_count, ' SYNs, ', bwd_packets, ' responses, ', rst_count, ' RST)')
      WHEN 4 THEN printf('known attack (confidence %.2f >= 0.90)', confidence)
      WHEN 5 THEN 'unusual pattern (novelty) - NOT a confirmed attack'
      WHEN 6 THEN printf('anomalous flow below block threshold (confidence %.2f)', confidence)
      ELSE 'normal flow' END AS reason FROM ruled)"""

BLOCKS = """blocks AS (
  SELECT attacker_ip AS ip, flow_id, ts_us AS blocked_at_us, ts_us + 172800000000 AS expires_at_us, reason, source
  FROM decisions WHERE action = 'block')"""

INTERVALS = """intervals AS (
  SELECT *, least(expires_at_us, replaced_at_us) AS end_us FROM (
    SELECT *, lead(blocked_at_us) OVER (PARTITION BY ip ORDER BY blocked_at_us, flow_id) AS replaced_at_us FROM blocks))"""

LOG = """log AS (
  SELECT 'SENSOR' AS layer, 'flow.features' AS type, last_us AS ts_us, flow_id * 4 AS seq, flow_id, NULL AS label,
    NULL::DOUBLE AS confidence, NULL::BOOLEAN AS novelty, NULL AS action, NULL AS attacker_ip, NULL AS reason,
    NULL AS source, NULL AS ip, NULL::INTEGER AS port, src_ip, dst_ip, src_port, dst_port, protocol FROM decisions
  UNION ALL
  SELECT 'L7', 'honeypot.probe', start_us, flow_id * 4 + 1, flow_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    src_ip, dst_port, NULL, NULL, NULL, NULL, NULL FROM decisions WHERE probe
  UNION ALL
  SELECT 'L6', 'decision', last_us, flow_id * 4 + 2, flow_id, label, decision_confidence, novelty, action, attacker_ip,
    reason, source, NULL, NULL, src_ip, dst_ip, src_port, dst_port, protocol FROM decisions
  UNION ALL
  SELECT 'L4', 'verdict', last_us, flow_id * 4 + 3, flow_id, label, confidence, novelty, NULL, NULL, NULL, NULL,
    NULL, NULL, src_ip, dst_ip, src_port, dst_port, protocol FROM decisions)"""

CORPUS = """corpus AS (
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS row_id,
  (l_orderkey * 48271 + l_linenumber * 16807 + l_partkey * 69621 + l_suppkey * 39373
    + CAST(l_quantity AS BIGINT)) % 2147483647 AS draw,
  concat('year_', year(l_shipdate), '.csv') AS source_file,
  CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE l_tax * 100 END AS flow_duration,
  CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS protocol,
  l_partkey % 1024 AS destination_port,
  CAST(l_quantity AS BIGINT) AS forward_packet_count,
  CAST(l_linenumber AS BIGINT) AS backward_packet_count,
  CAST(floor(l_extendedprice) AS BIGINT) AS forward_bytes,
  CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS backward_bytes,
  CASE WHEN l_tax = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (l_quantity + l_linenumber) / (l_tax * 100) END AS packets_per_second,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 10 < 8 THEN 50 + CAST(l_quantity AS BIGINT)
       ELSE CAST(l_quantity AS BIGINT) % 3 END AS syn_count,
  CAST(l_quantity AS BIGINT) % 20 AS ack_count,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN l_linenumber ELSE 0 END AS rst_count,
  CASE WHEN l_returnflag = 'R' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'DDoS' ELSE 'PortScan' END)
       WHEN l_returnflag = 'A' THEN ' benign ' ELSE 'BENIGN' END AS Label
FROM lineitem)"""

_MAP = [("flow_duration", "flow_duration"), ("protocol", "protocol"), ("dst_port", "destination_port"),
        ("total_fwd_packets", "forward_packet_count"), ("total_bwd_packets", "backward_packet_count"),
        ("total_fwd_bytes", "forward_bytes"), ("total_bwd_bytes", "backward_bytes"),
        ("packets_per_second", "packets_per_second"), ("syn_count", "syn_count"), ("ack_count", "ack_count"),
        ("rst_count", "rst_count")]
NAMES = [feature for feature, _ in _MAP]

CLEAN = "clean AS (SELECT row_id, draw, source_file, " + ", ".join(
    f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END AS {f}" for f, c in _MAP) + \
    ", CASE WHEN upper(trim(Label)) = 'BENIGN' THEN 'BENIGN' ELSE 'ANOMALY' END AS label FROM corpus)"

# three deterministic stand-ins for trained models
PREDICTIONS = """predictions AS (
  SELECT 'syn_rule' AS model, 'supervised' AS kind, label, CASE WHEN syn_count >= 50 THEN 'ANOMALY' ELSE 'BENIGN' END AS predicted,
    0.5 + CAST(total_fwd_bytes % 50 AS DOUBLE) / 100 AS confidence, CAST(0.5 AS DOUBLE) AS threshold FROM clean
  UNION ALL
  SELECT 'port_rule', 'supervised', label, CASE WHEN dst_port % 3 = 0 THEN 'ANOMALY' ELSE 'BENIGN' END,
    0.5 + CAST(total_bwd_bytes % 50 AS DOUBLE) / 100, CAST(0.7 AS DOUBLE) FROM clean
  UNION ALL
  SELECT 'never', 'novelty', label, 'BENIGN', 1.0, CAST(0.0 AS DOUBLE) FROM clean)"""

CONFUSION = """counts AS (SELECT model, label, predicted, count(*) AS n FROM predictions GROUP BY ALL)"""

CLASS_METRICS = """per_class AS (
  SELECT model, class, sum(CASE WHEN label = class AND predicted = class THEN n ELSE 0 END) AS hit,
    sum(CASE WHEN label = class THEN n ELSE 0 END) AS support, sum(CASE WHEN predicted = class THEN n ELSE 0 END) AS called
  FROM counts, (VALUES ('ANOMALY'), ('BENIGN')) c(class) GROUP BY model, class),
rates AS (SELECT *, coalesce(hit / nullif(called, 0), 0) AS "precision", coalesce(hit / nullif(support, 0), 0) AS recall FROM per_class),
class_metrics AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM rates)"""


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


PACKET_PARTS = (PACKETS, ACCEPTED)
FLOW_PARTS = (PACKETS, ACCEPTED, segments(), FLOWS)
FEATURE_PARTS = (*FLOW_PARTS, FEATURES)
VERDICT_PARTS = (*FEATURE_PARTS, SCORED)
DECISION_PARTS = (*VERDICT_PARTS, DECIDED)
BLOCK_PARTS = (*DECISION_PARTS, BLOCKS)
LOG_PARTS = (*DECISION_PARTS, LOG)
CORPUS_PARTS = (CORPUS, CLEAN)
METRIC_PARTS = (CORPUS, CLEAN, PREDICTIONS, CONFUSION)
