"""Verdicts, decoy probes and the ordered allow / alert / block policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.options import Options
from flowsieve.schemas import ANOMALY, BENIGN, CLASSES

ALLOW, ALERT, BLOCK = "allow", "alert", "block"

# Reason texts of the policy.
REASON_WHITELIST = "whitelisted host - never blocked"
REASON_PROBE = "honeypot probe - no real service should be contacted"
REASON_FLOOD = "SYN flood (%d SYNs, %d responses, %d RST)"
REASON_ATTACK = "known attack (confidence %.2f >= %.2f)"
REASON_NOVELTY = "unusual pattern (novelty) - NOT a confirmed attack"
REASON_BELOW = "anomalous flow below block threshold (confidence %.2f)"
REASON_NORMAL = "normal flow"


def classify(scored: DataFrame, probability: str = "probability", classes: list[str] = CLASSES) -> DataFrame:
    """Class probabilities to label, confidence and benign probability; ties go to the first class."""
    if sorted(classes) != sorted(CLASSES):
        raise ValueError(f"expected the two classes {CLASSES}, got {classes}")
    p = F.col(probability)
    first, second = p[0], p[1]
    return scored.withColumns({
        "benign_probability": p[classes.index(BENIGN)],
        "label": F.when(first >= second, F.lit(classes[0])).otherwise(F.lit(classes[1])),
        "confidence": F.greatest(first, second)})


def flag_novelty(scored: DataFrame, threshold: float | None) -> DataFrame:
    """Strictly below the threshold is novel; without a detector both columns are null."""
    if threshold is None or "anomaly_score" not in scored.columns:
        return scored.withColumns({"anomaly_score": F.lit(None).cast("double"), "novelty": F.lit(None).cast("boolean")})
    return scored.withColumn("novelty", F.col("anomaly_score") < F.lit(threshold))


def flag_alert(scored: DataFrame, opts: Options) -> DataFrame:
    known = (F.col("label") == ANOMALY) & (F.col("confidence") >= opts.alert_confidence)
    return scored.withColumn("alert", known | F.coalesce(F.col("novelty"), F.lit(False)))


def verdicts(scored: DataFrame, opts: Options, novelty_threshold: float | None) -> DataFrame:
    return flag_alert(flag_novelty(classify(scored), novelty_threshold), opts)


def is_probe(opts: Options) -> Column:
    """TCP flow to a decoy port; with `honeypot_require_ack` only when a handshake can have completed."""
    if not opts.block_honeypot_enabled:
        return F.lit(False)
    hit = (F.col("protocol") == 6) & F.col("dst_port").isin(opts.honeypot_ports)
    return (hit & (F.col("ack_count") > 0)) if opts.honeypot_require_ack else hit


def probe_events(flows: DataFrame, opts: Options) -> DataFrame:
    return flows.filter(is_probe(opts)).select(
        "flow_id", F.col("start_us").alias("ts_us"), F.col("src_ip").alias("ip"), F.col("dst_port").alias("port"))


def probe_verdicts(probes: DataFrame) -> DataFrame:
    """The fixed verdict of a decoy contact."""
    return probes.withColumns({
        "attacker_ip": F.col("ip"), "probe": F.lit(True),
        "label": F.lit(ANOMALY), "confidence": F.lit(1.0), "benign_probability": F.lit(0.0),
        "alert": F.lit(True), "novelty": F.lit(False), "anomaly_score": F.lit(0.0)})


def attacker(columns: list[str]) -> Column:
    """Explicit address, else the flow's initiator, else empty."""
    found = [F.nullif(F.col("attacker_ip"), F.lit(""))] if "attacker_ip" in columns else []
    found += [F.col("src_ip")] if "src_ip" in columns else []
    return F.coalesce(*found, F.lit(""))


def whitelist_flag(rows: DataFrame, opts: Options, ip: str, table: DataFrame | None = None) -> DataFrame:
    """Exact text match. A table of hosts is joined on its distinct addresses."""
    if table is None:
        return rows.withColumn("whitelisted", F.coalesce(F.col(ip).isin(list(opts.whitelist)), F.lit(False)))
    hosts = table.select(F.col("ip").alias(ip)).distinct().withColumn("listed", F.lit(True))
    return (rows.join(hosts, ip, "left")
            .withColumn("whitelisted", F.coalesce("listed", F.lit(False))).drop("listed"))


def decide(rows: DataFrame, opts: Options, whitelist: DataFrame | None = None) -> DataFrame:
    """Adds the struct `decision`; the first rule that matches wins."""
    have = rows.columns
    rows = whitelist_flag(rows.withColumn("attacker_ip", attacker(have)), opts, "attacker_ip", whitelist)
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    probe = F.coalesce(F.col("probe"), F.lit(False)) if "probe" in have else F.lit(False)
    flood, flood_text = F.lit(False), F.lit("")
    if "syn_count" in have and "bwd_packets" in have:
        unanswered = (F.col("bwd_packets") == 0) | (F.col("rst_count") == F.col("bwd_packets"))
        flood = F.coalesce((F.col("syn_count") >= opts.syn_flood_minimum) & unanswered, F.lit(False))
        flood_text = F.format_string(REASON_FLOOD, "syn_count", "bwd_packets", "rst_count")
    novelty = F.coalesce(F.col("novelty"), F.lit(False))
    attack = (F.col("label") == ANOMALY) & (confidence >= opts.block_confidence)

    def outcome(action, reason, certainty, source) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(action).alias("action"), F.col("attacker_ip").alias("attacker_ip"),
                        text.alias("reason"), certainty.alias("confidence"), F.lit(source).alias("source"))

    sure = F.lit(1.0)
    decision = (
        F.when(F.col("whitelisted"), outcome(ALLOW, REASON_WHITELIST, confidence, "whitelist"))
        .when(probe, outcome(BLOCK, REASON_PROBE, sure, "honeypot"))
        .when(flood, outcome(BLOCK, flood_text, sure, "rule"))
        .when(attack, outcome(BLOCK, F.format_string(REASON_ATTACK, confidence, F.lit(opts.block_confidence)),
                              confidence, "model"))
        .when(F.col("alert") & novelty, outcome(ALERT, REASON_NOVELTY, confidence, "novelty"))
        .when(F.col("alert"), outcome(ALERT, F.format_string(REASON_BELOW, confidence), confidence, "model"))
        .otherwise(outcome(ALLOW, REASON_NORMAL, confidence, "model")))
    return rows.withColumn("decision", decision).drop("whitelisted")


def flat(decided: DataFrame) -> DataFrame:
    """Decision fields as plain columns; the verdict's own confidence becomes verdict_confidence."""
    return (decided.withColumnRenamed("confidence", "verdict_confidence").drop("attacker_ip", "source")
            .select("*", "decision.*").drop("decision"))


def verdict_lines(rows: DataFrame) -> DataFrame:
    """Console lines of scored flows: tag, label, confidence, novelty and the novelty note."""
    novel = F.when(F.col("anomaly_score").isNotNull(), F.concat(
        F.lit("  novelty="), F.when(F.col("novelty"), F.lit("YES")).otherwise(F.lit("no ")),
        F.format_string(" score=%.4f", "anomaly_score"))).otherwise(F.lit(""))
    tag = F.when(F.col("alert"), F.lit("ALERT")).otherwise(F.lit("ok   "))
    line = F.concat(F.lit("["), tag, F.lit("] label="), F.rpad("label", 8, " "),
                    F.format_string(" conf=%.4f", "confidence"), novel)
    note = F.when(F.col("novelty") & (F.col("label") == BENIGN),
                  F.lit("note: novelty flag - unusual pattern, NOT a known attack"))
    return rows.withColumns({"line": line, "note": note})
