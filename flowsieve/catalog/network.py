"""Queries on packets, flows, features, verdicts, decisions, blocks and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import fixtures as fx
from flowsieve.catalog import sql
from flowsieve.catalog.registry import query
from flowsieve.catalog.sql import NAMES, with_
from flowsieve.functions import text
from flowsieve.functions.addresses import ip_family
from flowsieve.operators import blocks as bl
from flowsieve.operators import explain, features, filters, flows, notify, policy
from flowsieve.operators.selection import quantiles
from flowsieve.schemas import BENIGN, FEATURES
from flowsieve.sources import blocks as block_files
from flowsieve.session import scratch_path

OPTS = fx.OPTIONS
DAY_US = 86_400_000_000


def accepted(spark: SparkSession, d: str) -> DataFrame:
    return filters.accept(fx.packets(spark, d), OPTS)


def flow_rows(spark: SparkSession, d: str) -> DataFrame:
    return flows.assemble(accepted(spark, d), OPTS)


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return features.extract(flow_rows(spark, d))


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.scores(feature_rows(spark, d))


def verdict_rows(spark: SparkSession, d: str) -> DataFrame:
    return policy.verdicts(scored_rows(spark, d), OPTS, fx.NOVELTY_THRESHOLD).withColumn("probe", policy.is_probe(OPTS))


def decided_rows(spark: SparkSession, d: str) -> DataFrame:
    return policy.decide(verdict_rows(spark, d), OPTS)


def decision_rows(spark: SparkSession, d: str) -> DataFrame:
    return policy.flat(decided_rows(spark, d)).withColumn("ts_us", F.col("last_us"))


def block_rows(spark: SparkSession, d: str) -> DataFrame:
    return bl.blocks_from_decisions(decision_rows(spark, d), OPTS)


def six(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)


def sql_six(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


# ---- packets

@query("filter_noise", with_(sql.PACKETS, select=f"SELECT packet_id, src_ip, dst_ip FROM packets WHERE NOT {sql.NOISE}"))
def filter_noise(spark, d):
    return filters.drop_noise(fx.packets(spark, d), OPTS).select("packet_id", "src_ip", "dst_ip")


@query("filter_capture", with_(sql.PACKETS, select="SELECT packet_id, protocol, src_port, dst_port FROM packets WHERE "
                               "src_port >= 0 AND dst_port >= 0 AND protocol IN (6, 17, 1) AND "
                               "(src_port IN (80, 443, 0) OR dst_port IN (80, 443, 0))"))
def filter_capture(spark, d):
    opts = OPTS.updated({"include_icmp": True, "port_allowlist": [80, 443, 0]})
    return filters.capture_filter(fx.packets(spark, d), opts).select("packet_id", "protocol", "src_port", "dst_port")


@query("filter_capture_ports", with_(sql.PACKETS, select="SELECT packet_id, src_port, dst_port FROM packets WHERE "
                                     "src_port IN (SELECT o_orderkey % 9000 FROM orders) OR dst_port IN (SELECT o_orderkey % 9000 FROM orders)"))
def filter_capture_ports(spark, d):
    ports = fx.table(spark, d, "orders").select((F.col("o_orderkey") % 9000).alias("port"))
    return filters.port_table_filter(fx.packets(spark, d), ports).select("packet_id", "src_port", "dst_port")


@query("capture_funnel", with_(sql.PACKETS, select=f"""
SELECT concat('if', packet_id % 3) AS iface, count(*) AS frames_received,
  count(*) FILTER (packet_id % 101 = 0) AS parse_errors, count(*) FILTER (packet_id % 101 <> 0) AS parsed,
  count(*) FILTER (packet_id % 101 <> 0 AND {sql.NOISE}) AS noise,
  count(*) FILTER (packet_id % 101 <> 0 AND NOT {sql.NOISE} AND NOT {sql.CAPTURED}) AS filtered,
  count(*) FILTER (packet_id % 101 <> 0 AND NOT {sql.NOISE} AND {sql.CAPTURED}) AS accepted
FROM packets GROUP BY 1"""))
def capture_funnel(spark, d):
    decoded = fx.packets(spark, d).withColumns({
        "iface": F.concat(F.lit("if"), F.col("packet_id") % 3),
        "parse_error": F.when(F.col("packet_id") % 101 == 0, F.lit("bad frame"))})
    return filters.capture_funnel(decoded, OPTS)


@query("packet_describe", with_(sql.PACKETS, select="""
SELECT packet_id, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END AS protocol_name,
  flags, concat(rpad(CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END, 4, ' '), ' ', src, ' -> ', dst,
    ' [', flags, '] ', size, 'B') AS line
FROM (SELECT *, CASE WHEN src_port = 0 THEN src_ip ELSE concat(src_ip, ':', src_port) END AS src,
  CASE WHEN dst_port = 0 THEN dst_ip ELSE concat(dst_ip, ':', dst_port) END AS dst,
  CASE WHEN protocol = 6 THEN concat(CASE WHEN tcp_flags & 1 <> 0 THEN 'F' ELSE '' END, CASE WHEN tcp_flags & 2 <> 0 THEN 'S' ELSE '' END,
    CASE WHEN tcp_flags & 4 <> 0 THEN 'R' ELSE '' END, CASE WHEN tcp_flags & 16 <> 0 THEN 'A' ELSE '' END)
    WHEN protocol = 1 THEN 'type=8' ELSE '' END AS flags FROM packets)"""))
def packet_describe(spark, d):
    flags = text.flag_text(F.col("protocol"), F.col("tcp_flags"), F.lit(8))
    src = text.endpoint(F.col("src_ip"), F.col("src_port"))
    dst = text.endpoint(F.col("dst_ip"), F.col("dst_port"))
    return fx.packets(spark, d).select(
        "packet_id", text.packet_protocol(F.col("protocol")).alias("protocol_name"), flags.alias("flags"),
        text.packet_text(F.col("protocol"), src, dst, flags, F.col("size")).alias("line"))


@query("ip_family", with_(sql.PACKETS, select="""
SELECT ip, CASE WHEN ip LIKE '%x' THEN NULL WHEN ip LIKE '%:%' THEN 'v6' ELSE 'v4' END AS family, count(*) AS n
FROM (SELECT CASE packet_id % 5 WHEN 0 THEN concat(src_ip, 'x') WHEN 1 THEN concat('2001:db8::', src_port % 9 + 1) ELSE src_ip END AS ip
      FROM packets) GROUP BY ip"""))
def ip_family_query(spark, d):
    ip = (F.when(F.col("packet_id") % 5 == 0, F.concat("src_ip", F.lit("x")))
          .when(F.col("packet_id") % 5 == 1, F.concat(F.lit("2001:db8::"), F.col("src_port") % 9 + 1)).otherwise(F.col("src_ip")))
    return (fx.packets(spark, d).select(ip.alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
            .select("ip", ip_family(F.col("ip")).alias("family"), "n"))


# ---- flows

@query("flow_key", with_(*sql.PACKET_PARTS, select="SELECT packet_id, lo, hi, protocol FROM accepted"))
def flow_key(spark, d):
    return flows.flow_key(accepted(spark, d)).select("packet_id", "lo", "hi", "protocol")


@query("flows_idle", with_(*sql.PACKET_PARTS, select="""
SELECT lo, hi, protocol, min(ts_us) AS session_start, max(ts_us) AS session_end, count(*) AS packets FROM (
  SELECT *, sum(opened) OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_id) > 259200000000
      THEN 1 ELSE 0 END AS opened FROM accepted)) GROUP BY lo, hi, protocol, session"""))
def flows_idle(spark, d):
    keyed = flows.flow_key(accepted(spark, d)).select(*flows.KEY, "ts_us", "packet_id")
    return (flows.idle_sessions(keyed, OPTS).groupBy(*flows.KEY, "session_start")
            .agg(F.max("ts_us").alias("session_end"), F.count("*").alias("packets")))


@query("flows_assemble", with_(*sql.FLOW_PARTS, select=f"SELECT {sql.FLOW_COLUMNS} FROM flows"))
def flows_assemble(spark, d):
    return flow_rows(spark, d)


@query("flows_assemble_split", with_(*sql.FLOW_PARTS, select=f"SELECT {sql.FLOW_COLUMNS} FROM flows"))
def flows_assemble_split(spark, d):
    """Same flows with every key above 40 packets treated as too large for one task."""
    return flows.assemble(accepted(spark, d), OPTS.updated({"hot_key_rows": 40}))


@query("flow_orientation", with_(*sql.FLOW_PARTS, select="SELECT flow_id, src_ip, src_port, dst_ip, dst_port FROM flows"))
def flow_orientation(spark, d):
    return flow_rows(spark, d).select("flow_id", "src_ip", "src_port", "dst_ip", "dst_port")


@query("flow_totals", with_(*sql.FLOW_PARTS, select="SELECT flow_id, fwd_packets + bwd_packets AS total_packets, "
                            "fwd_bytes + bwd_bytes AS total_bytes, greatest(0, last_us - start_us) AS duration_us FROM flows"))
def flow_totals(spark, d):
    return flows.flow_totals(flow_rows(spark, d)).select("flow_id", "total_packets", "total_bytes", "duration_us")


@query("flow_describe", with_(*sql.FLOW_PARTS, select="""
SELECT flow_id, concat('flow ', CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END, ' ', src_ip, ':', src_port, ' -> ', dst_ip, ':', dst_port,
  '  fwd=', fwd_packets, 'p/', fwd_bytes, 'B bwd=', bwd_packets, 'p/', bwd_bytes, 'B  syn=', syn_count, ' ack=', ack_count,
  ' fin=', fin_count, ' rst=', rst_count, '  ') AS line FROM flows"""))
def flow_describe(spark, d):
    # the duration at the end has two rounded digits, on which the engines differ at ties
    return flow_rows(spark, d).select("flow_id", F.regexp_replace(text.flow_text(), r"dur=[0-9.]+s$", "").alias("line"))


@query("display_cells", with_(*sql.VERDICT_PARTS, select="""
SELECT flow_id, CASE WHEN flow_id % 9 = 0 THEN '—' ELSE strftime(make_timestamp(last_us), '%H:%M:%S') END AS shown_time,
  CASE WHEN flow_id % 7 = 0 THEN '—' WHEN p_anomaly = floor(p_anomaly) THEN CAST(p_anomaly::BIGINT AS VARCHAR) ELSE printf('%.4f', p_anomaly) END AS cell,
  concat(printf('%.2f', p_anomaly * 100), '%') AS share FROM verdicts"""))
def display_cells(spark, d):
    """Times, numbers and shares as the views show them; absent ones are a dash."""
    rows = fx.scores(feature_rows(spark, d))
    p, absent = F.col("probability")[0], lambda n, value: F.when(F.col("flow_id") % n != 0, value)
    return rows.select("flow_id", text.shown_time(absent(9, F.col("last_us") / F.lit(1e6))).alias("shown_time"),
                       text.shown(absent(7, p)).alias("cell"), text.percent(p).alias("share"))


# ---- features

@query("flow_features", with_(*sql.FEATURE_PARTS, select="SELECT flow_id, " + ", ".join(
    (f"round({n}, 6) AS {n}" if n in ("flow_duration", "packets_per_second") else n) for n in NAMES) + " FROM features"))
def flow_features(spark, d):
    return feature_rows(spark, d).select("flow_id", *[
        six(n) if n in ("flow_duration", "packets_per_second") else F.col(n) for n in FEATURES])


@query("feature_vector", with_(*sql.FEATURE_PARTS, select="SELECT flow_id, " + ", ".join(
    f"round(v[{i + 1}], 6) AS v{i}" for i in range(11)) + " FROM (SELECT flow_id, [" + ", ".join(
    f"CAST({n} AS DOUBLE)" for n in NAMES) + "] AS v FROM features)"))
def feature_vector(spark, d):
    rows = feature_rows(spark, d).select("flow_id", features.vector().alias("v"))
    return rows.select("flow_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(11)])


@query("score_defaults", with_(*sql.FEATURE_PARTS, select="SELECT flow_id, " + ", ".join(
    f"0.0::DOUBLE AS {n}" if n in ("syn_count", "rst_count") else
    ("CASE WHEN flow_id % 4 = 0 THEN 0.0::DOUBLE ELSE dst_port::DOUBLE END AS dst_port" if n == "dst_port"
     else f"round({n}::DOUBLE, 6) AS {n}") for n in NAMES) + " FROM features"))
def score_defaults(spark, d):
    partial = (feature_rows(spark, d).drop("syn_count", "rst_count")
               .withColumn("dst_port", F.when(F.col("flow_id") % 4 != 0, F.col("dst_port"))))
    return features.with_defaults(partial).select("flow_id", *[six(n) for n in FEATURES])


@query("minmax_fit", with_(*sql.FEATURE_PARTS, select=" UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS feature, round(min({n})::DOUBLE, 6) AS low, round(max({n})::DOUBLE, 6) AS high FROM features"
    for i, n in enumerate(NAMES))))
def minmax_fit(spark, d):
    return features.minmax_fit(feature_rows(spark, d)).select("position", "feature", six("low"), six("high"))


_SCALED = ", ".join(f"round((f.{n} - s.lo_{n}) / (CASE WHEN s.hi_{n} > s.lo_{n} THEN s.hi_{n} - s.lo_{n} ELSE 1 END)::DOUBLE, 6) AS {n}" for n in NAMES)
_STATS = "stats AS (SELECT " + ", ".join(f"min({n}) AS lo_{n}, max({n}) AS hi_{n}" for n in NAMES) + " FROM features)"


@query("minmax_apply", with_(*sql.FEATURE_PARTS, _STATS, select=f"SELECT flow_id, {_SCALED} FROM features f, stats s"))
def minmax_apply(spark, d):
    rows = feature_rows(spark, d)
    return features.minmax_apply(rows, features.minmax_fit(rows)).select("flow_id", *[six(n) for n in FEATURES])


@query("feature_preview", with_(*sql.FEATURE_PARTS, _STATS, select="SELECT f.flow_id, f.start_us, " + ", ".join(
    f"round(f.{n}::DOUBLE, 6) AS {n}" for n in NAMES) + ", " + _SCALED.replace(" AS ", " AS sc_") +
    " FROM (SELECT * FROM features ORDER BY start_us, flow_id LIMIT 6) f, stats s"))
def feature_preview(spark, d):
    rows = features.preview(feature_rows(spark, d))
    return rows.select("flow_id", "start_us", *[six(n) for n in FEATURES],
                       *[F.round(F.col(f"{n}_scaled"), 6).alias(f"sc_{n}") for n in FEATURES])


@query("scaler_roundtrip", with_(*sql.FEATURE_PARTS, _STATS, select=f"SELECT flow_id, {_SCALED} FROM features f, stats s"))
def scaler_roundtrip(spark, d):
    rows = feature_rows(spark, d)
    path = scratch_path(spark, "scaler")
    features.save_stats(features.minmax_fit(rows), path)
    return features.minmax_apply(rows, features.load_stats(spark, path)).select("flow_id", *[six(n) for n in FEATURES])


# ---- verdicts and decisions

@query("classify", with_(*sql.VERDICT_PARTS, select="SELECT flow_id, label, " + sql_six("confidence", "benign_probability") + " FROM verdicts"))
def classify(spark, d):
    return policy.classify(scored_rows(spark, d)).select("flow_id", "label", six("confidence"), six("benign_probability"))


@query("novelty_flag", with_(*sql.VERDICT_PARTS, select="SELECT flow_id, " + sql_six("anomaly_score") + ", novelty FROM verdicts"))
def novelty_flag(spark, d):
    return policy.flag_novelty(scored_rows(spark, d), fx.NOVELTY_THRESHOLD).select("flow_id", six("anomaly_score"), "novelty")


@query("alert_flag", with_(*sql.VERDICT_PARTS, select="SELECT flow_id, label, novelty, alert FROM verdicts"))
def alert_flag(spark, d):
    return verdict_rows(spark, d).select("flow_id", "label", "novelty", "alert")


@query("verdict_lines", with_(*sql.VERDICT_PARTS, select="""
SELECT flow_id, printf('[%s] label=%s conf=%.4f  novelty=%s score=%.4f', CASE WHEN alert THEN 'ALERT' ELSE 'ok   ' END, rpad(label, 8, ' '), confidence,
    CASE WHEN novelty THEN 'YES' ELSE 'no ' END, anomaly_score) AS line,
  CASE WHEN novelty AND label = 'BENIGN' THEN 'note: novelty flag - unusual pattern, NOT a known attack' END AS note FROM verdicts"""))
def verdict_lines(spark, d):
    return policy.verdict_lines(verdict_rows(spark, d)).select("flow_id", "line", "note")


@query("novelty_threshold", with_(*sql.VERDICT_PARTS, select="SELECT round(quantile_cont(anomaly_score, 0.01), 6) AS threshold FROM verdicts WHERE label = 'BENIGN'"))
def novelty_threshold(spark, d):
    benign = policy.classify(scored_rows(spark, d)).filter(F.col("label") == BENIGN)
    return spark.range(1).select(F.round(F.lit(quantiles(benign, ["anomaly_score"], 0.01)["anomaly_score"]), 6).alias("threshold"))


@query("whitelist_flag", with_(*sql.FLOW_PARTS, select="SELECT flow_id, src_ip, src_ip IN (SELECT concat('10.0.0.', c_custkey % 40 + 1) FROM customer) AS whitelisted FROM flows"))
def whitelist_flag(spark, d):
    hosts = fx.table(spark, d, "customer").select(F.concat(F.lit("10.0.0."), F.col("c_custkey") % 40 + 1).alias("ip")).distinct()
    return policy.whitelist_flag(flow_rows(spark, d), OPTS, "src_ip", hosts).select("flow_id", "src_ip", "whitelisted")


@query("decide", with_(*sql.DECISION_PARTS, select="SELECT flow_id, action, attacker_ip, source, round(decision_confidence, 6) AS confidence FROM decisions"))
def decide(spark, d):
    return decision_rows(spark, d).select("flow_id", "action", "attacker_ip", "source", six("confidence"))


@query("decision_reason", with_(*sql.DECISION_PARTS, select="SELECT flow_id, rule, CASE WHEN rule IN (4, 6) THEN regexp_replace(reason, '[0-9]+[.][0-9]+', '#', 'g') ELSE reason END AS reason FROM decisions"))
def decision_reason(spark, d):
    rows = decision_rows(spark, d)
    rule = (F.when(F.col("source") == "whitelist", 1).when(F.col("source") == "honeypot", 2).when(F.col("source") == "rule", 3)
            .when(F.col("source") == "novelty", 5).when(F.col("action") == "block", 4).when(F.col("action") == "alert", 6).otherwise(7))
    plain = F.when(F.col("source") == "model", F.regexp_replace("reason", r"[0-9]+[.][0-9]+", "#")).otherwise(F.col("reason"))
    return rows.select("flow_id", rule.alias("rule"), plain.alias("reason"))


@query("verdict_decision_join", with_(*sql.DECISION_PARTS, select="SELECT flow_id, label, novelty, alert, action, source, round(confidence, 6) AS verdict_confidence, round(decision_confidence, 6) AS confidence FROM decisions"))
def verdict_decision_join(spark, d):
    """Two logs, one of verdicts and one of decisions, matched by flow."""
    left = verdict_rows(spark, d).select("flow_id", "label", "novelty", "alert", six("confidence").alias("verdict_confidence"))
    right = decision_rows(spark, d).select("flow_id", "action", "source", six("confidence"))
    return left.join(right, "flow_id")


@query("decision_counts", with_(*sql.DECISION_PARTS, select="SELECT action, source, count(*) AS flows, count(DISTINCT attacker_ip) AS hosts FROM decisions GROUP BY ALL"))
def decision_counts(spark, d):
    return decision_rows(spark, d).groupBy("action", "source").agg(
        F.count("*").alias("flows"), F.count_distinct("attacker_ip").alias("hosts"))


@query("probe_events", with_(*sql.FLOW_PARTS, select="SELECT flow_id, start_us AS ts_us, src_ip AS ip, dst_port AS port FROM flows WHERE protocol = 6 AND dst_port = 2323"))
def probe_events(spark, d):
    return policy.probe_events(flow_rows(spark, d), OPTS)


@query("probe_decisions", with_(*sql.FLOW_PARTS, select="""
SELECT flow_id, 'ANOMALY' AS label, src_ip AS attacker_ip, CASE WHEN src_ip IN ('10.0.0.1', '192.168.0.1') THEN 'allow' ELSE 'block' END AS action,
  CASE WHEN src_ip IN ('10.0.0.1', '192.168.0.1') THEN 'whitelist' ELSE 'honeypot' END AS source, 1.0::DOUBLE AS confidence
FROM flows WHERE protocol = 6 AND dst_port = 2323"""))
def probe_decisions(spark, d):
    probes = policy.probe_verdicts(policy.probe_events(flow_rows(spark, d), OPTS))
    return policy.flat(policy.decide(probes, OPTS)).select("flow_id", "label", "attacker_ip", "action", "source", "confidence")


# ---- explanations of fixed contributions

_PHI = "CAST((fwd_bytes * (p + 1) + dst_port * (p + 3) + bwd_bytes + flow_id) % 401 - 200 AS DOUBLE) / 1000"


def contribution_rows(spark, d):
    phi = F.array(*[F.expr(_PHI.replace("p + 1", f"{i} + 1").replace("p + 3", f"{i} + 3")) for i in range(11)])
    return feature_rows(spark, d).withColumns({"phi": phi, "values": features.vector()})


_LONG = "contributions AS (SELECT f.*, p, n.name AS feature, " + _PHI + " AS phi FROM features f, (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(NAMES)) + ") n(p, name))"
_WORDS = "names AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in explain.DISPLAY.items()) + ") t(feature, shown))"
_VALUE = "CASE feature " + " ".join(f"WHEN '{n}' THEN CAST({n} AS DOUBLE)" for n in NAMES) + " END"


@query("explain_top", with_(*sql.FEATURE_PARTS, _LONG, select="""
SELECT flow_id, coalesce(nullif(concat_ws(' | ',
  'toward ANOMALY: ' || string_agg(printf('%s=%+.3f', feature, phi), ', ' ORDER BY up) FILTER (phi > 0 AND up <= 3),
  'toward BENIGN:  ' || string_agg(printf('%s=%+.3f', feature, phi), ', ' ORDER BY down) FILTER (phi < 0 AND down <= 3)), ''),
  'all features ~neutral') AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY phi DESC, feature DESC) AS up,
        row_number() OVER (PARTITION BY flow_id ORDER BY phi, feature) AS down FROM contributions) GROUP BY flow_id"""))
def explain_top(spark, d):
    return contribution_rows(spark, d).select("flow_id", explain.top_text(F.col("phi")).alias("reason"))


@query("explain_text", with_(*sql.FEATURE_PARTS, _LONG, _WORDS, select=f"""
SELECT flow_id, string_agg(concat(shown, '=', CASE WHEN {_VALUE} = floor({_VALUE}) AND {_VALUE} < 100000 THEN CAST(CAST({_VALUE} AS BIGINT) AS VARCHAR) ELSE printf('%g', {_VALUE}) END, ' → ',
  CASE WHEN phi > 0.01 THEN concat('ATTACK-like (', word, ')') WHEN phi < -0.01 THEN concat('NORMAL (', word, ')') ELSE 'neutral' END),
  ' · ' ORDER BY place) AS reason
FROM (SELECT *, CASE WHEN abs(phi) < 0.05::DOUBLE THEN 'weak' WHEN abs(phi) < 0.2::DOUBLE THEN 'moderate' ELSE 'strong' END AS word,
        row_number() OVER (PARTITION BY flow_id ORDER BY abs(phi) DESC, p) AS place FROM contributions) JOIN names USING (feature)
WHERE place <= 3 GROUP BY flow_id"""))
def explain_text(spark, d):
    return contribution_rows(spark, d).select("flow_id", explain.readable_text(F.col("phi"), F.col("values")).alias("reason"))


# ---- blocks and notifications

@query("blocks_from_decisions", with_(*sql.BLOCK_PARTS, select="SELECT ip, flow_id, blocked_at_us, expires_at_us, source FROM blocks"))
def blocks_from_decisions(spark, d):
    return block_rows(spark, d).select("ip", "flow_id", "blocked_at_us", "expires_at_us", "source")


@query("block_intervals", with_(*sql.BLOCK_PARTS, sql.INTERVALS, select="SELECT ip, flow_id, blocked_at_us, replaced_at_us, end_us FROM intervals"))
def block_intervals(spark, d):
    return bl.intervals(block_rows(spark, d), OPTS).select("ip", "flow_id", "blocked_at_us", "replaced_at_us", "end_us")


_LATEST = "latest AS (SELECT ip, flow_id, blocked_at_us, expires_at_us, source FROM blocks QUALIFY row_number() OVER (PARTITION BY ip ORDER BY blocked_at_us DESC, flow_id DESC) = 1)"


@query("blocks_latest", with_(*sql.BLOCK_PARTS, _LATEST, select="SELECT * FROM latest"))
def blocks_latest(spark, d):
    return bl.newest_first(block_rows(spark, d)).select("ip", "flow_id", "blocked_at_us", "expires_at_us", "source")


@query("blocks_list", with_(*sql.BLOCK_PARTS, select="SELECT DISTINCT ip FROM blocks"))
def blocks_list(spark, d):
    return bl.listed(block_rows(spark, d))


@query("blocks_active", with_(*sql.BLOCK_PARTS, select=f"""
SELECT ip, at_us AS blocked_at_us, expires_at_us, expires_at_us - {fx.NOW_US} AS remaining_us FROM (
  SELECT ip, blocked_at_us AS at_us, 0 AS rank, flow_id, expires_at_us FROM blocks
  UNION ALL SELECT ip, max(blocked_at_us) + 1000000, 1, 0, NULL FROM blocks GROUP BY ip HAVING max(flow_id) % 4 = 0)
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY at_us DESC, rank DESC, flow_id DESC) = 1 AND rank = 0
  AND (expires_at_us IS NULL OR {fx.NOW_US} < expires_at_us)"""))
def blocks_active(spark, d):
    blocks = block_rows(spark, d)
    unblocks = (blocks.groupBy("ip").agg(F.max("flow_id").alias("m"), (F.max("blocked_at_us") + 1_000_000).alias("ts_us"))
                .filter("m % 4 = 0").select("ip", "ts_us"))
    return bl.active(bl.with_unblocks(blocks, unblocks), fx.NOW_US)


@query("blocks_scan", with_(*sql.BLOCK_PARTS, _LATEST, select="SELECT ip, blocked_at_us, CASE WHEN source = 'rule' THEN NULL ELSE expires_at_us END AS expires_at_us FROM latest"))
def blocks_scan(spark, d):
    """Written as JSON text and read back; rows of one source are permanent."""
    state = bl.latest(block_rows(spark, d)).withColumn("expires_at_us", F.when(F.col("source") != "rule", F.col("expires_at_us")))
    path = scratch_path(spark, "blocks")
    block_files.to_json(state).write.text(path)
    return block_files.parse_snapshot(spark.read.text(path))


_HIT = "EXISTS (SELECT 1 FROM intervals b WHERE b.ip = p.src_ip AND p.ts_us >= b.blocked_at_us AND (b.end_us IS NULL OR p.ts_us < b.end_us))"


def _enforced(spark, d):
    return bl.enforce(accepted(spark, d), bl.intervals(block_rows(spark, d), OPTS), OPTS)


@query("enforce_dropped", with_(*sql.BLOCK_PARTS, sql.INTERVALS, select=f"SELECT packet_id, ts_us, src_ip FROM accepted p WHERE {_HIT}"))
def enforce_dropped(spark, d):
    return _enforced(spark, d).filter("dropped").select("packet_id", "ts_us", "src_ip")


@query("enforce_passed", with_(*sql.BLOCK_PARTS, sql.INTERVALS, select=f"SELECT packet_id, ts_us, src_ip FROM accepted p WHERE NOT {_HIT}"))
def enforce_passed(spark, d):
    return _enforced(spark, d).filter("NOT dropped").select("packet_id", "ts_us", "src_ip")


ACCEPTED_NOTES = """queue AS (SELECT *, row_number() OVER (ORDER BY blocked_at_us, flow_id) AS rn FROM blocks),
notes AS (
  SELECT rn, flow_id, ip, source, reason, blocked_at_us AS ts_us, blocked_at_us AS clock, true AS ok FROM queue WHERE rn = 1
  UNION ALL
  SELECT q.rn, q.flow_id, q.ip, q.source, q.reason, q.blocked_at_us,
    CASE WHEN q.blocked_at_us - n.clock >= 21600000000 THEN q.blocked_at_us ELSE n.clock END,
    q.blocked_at_us - n.clock >= 21600000000
  FROM notes n JOIN queue q ON q.rn = n.rn + 1)"""


def _notes(spark, d):
    return notify.accepted(notify.requests(block_rows(spark, d), OPTS), OPTS)


@query("notify_accept", with_(*sql.BLOCK_PARTS, ACCEPTED_NOTES, select="SELECT 'outbox' AS channel, ts_us, flow_id, ip FROM notes WHERE ok"))
def notify_accept(spark, d):
    return _notes(spark, d).select("channel", "ts_us", "flow_id", "ip")


@query("notify_accept_doubling", with_(*sql.BLOCK_PARTS, ACCEPTED_NOTES, select="SELECT 'outbox' AS channel, ts_us, flow_id, ip FROM notes WHERE ok"))
def notify_accept_doubling(spark, d):
    """Same notifications, with the channel treated as too large for one task."""
    asked = notify.requests(block_rows(spark, d), OPTS)
    return notify.accepted(asked, OPTS, fold_rows=0).select("channel", "ts_us", "flow_id", "ip")


@query("notify_outbox", with_(*sql.BLOCK_PARTS, ACCEPTED_NOTES, select="""
SELECT 'outbox' AS channel, flow_id, concat('**IP BLOCKED:** ', ip, chr(10), 'Reason: ', regexp_replace(reason, '[0-9]+[.][0-9]+', '#', 'g'), chr(10),
  'Source: ', source, ' | ', strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S')) AS message FROM notes WHERE ok"""))
def notify_outbox(spark, d):
    plain = _notes(spark, d).withColumn("reason", F.regexp_replace("reason", r"[0-9]+[.][0-9]+", "#"))
    return notify.outbox(plain).select("channel", "flow_id", "message")


@query("notify_counts", with_(*sql.BLOCK_PARTS, ACCEPTED_NOTES, select="SELECT 'outbox' AS channel, count(*) AS accepted, count(*) FILTER (flow_id % 5 <> 0) AS sent FROM notes WHERE ok"))
def notify_counts(spark, d):
    status = F.when(F.col("flow_id") % 5 == 0, F.lit("failed")).otherwise(F.lit("sent"))
    return notify.counters(_notes(spark, d).withColumn("status", status))
