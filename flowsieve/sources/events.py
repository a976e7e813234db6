"""Event log: one JSON object per line, read tolerantly and written by append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.schemas import EVENT, FEATURE_ROW, FEATURES

LINES = "line_no bigint, value string"


def flow_record() -> Column:
    seconds = lambda c: (F.col(c) / F.lit(1e6))
    return F.struct(
        "protocol", "src_ip", "dst_ip", "src_port", "dst_port",
        seconds("start_us").alias("start_ts"), seconds("last_us").alias("last_ts"),
        (F.greatest(F.lit(0), F.col("last_us") - F.col("start_us")) / F.lit(1e6)).alias("duration"),
        "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
        "syn_count", "ack_count", "fin_count", "rst_count", F.lit(None).cast("string").alias("honeypot"))


def feature_record() -> Column:
    return F.struct(*[F.col(n).cast("double").alias(n) for n in FEATURES])


def _stamped(rows: DataFrame, layer: str, kind: str, ts: str) -> DataFrame:
    return rows.withColumns({"layer": F.lit(layer), "type": F.lit(kind), "ts": F.col(ts) / F.lit(1e6)})


def feature_events(features: DataFrame) -> DataFrame:
    return (_stamped(features, "SENSOR", "flow.features", "last_us")
            .select("layer", "type", "ts", "flow_id", flow_record().alias("flow"), feature_record().alias("features")))


def verdict_events(verdicts: DataFrame) -> DataFrame:
    return (_stamped(verdicts, "L4", "verdict", "last_us")
            .select("layer", "type", "ts", "flow_id", "label", "confidence",
                    F.coalesce("novelty", F.lit(False)).alias("novelty"), "anomaly_score",
                    flow_record().alias("flow"), feature_record().alias("features")))


def probe_verdict_events(probe_verdicts: DataFrame) -> DataFrame:
    return (_stamped(probe_verdicts, "L4", "verdict", "ts_us")
            .select("layer", "type", "ts", "flow_id", "label", "confidence", "novelty", "anomaly_score",
                    F.struct(F.col("ip").alias("honeypot")).alias("flow")))


def decision_events(decided: DataFrame, ts: str = "last_us", with_flow: bool = True) -> DataFrame:
    explanation = F.col("explanation") if "explanation" in decided.columns else F.lit(None).cast("string")
    extra = [flow_record().alias("flow")] if with_flow else []
    return (_stamped(decided, "L6", "decision", ts)
            .select("layer", "type", "ts", "flow_id", "decision.action", "decision.attacker_ip", "decision.reason",
                    "decision.confidence", "decision.source", "label",
                    F.coalesce("novelty", F.lit(False)).alias("novelty"), explanation.alias("explanation"), *extra))


def probe_log_events(probes: DataFrame) -> DataFrame:
    return _stamped(probes, "L7", "honeypot.probe", "ts_us").select("layer", "type", "ts", "flow_id", "ip", "port")


def union(*parts: DataFrame) -> DataFrame:
    """Rows of all kinds in one wide record; a field a kind lacks is null."""
    def widened(df: DataFrame) -> DataFrame:
        if "flow" in df.columns and "honeypot" in df.schema["flow"].dataType.names and \
                len(df.schema["flow"].dataType.names) == 1:
            full = T.StructType.fromDDL(EVENT)["flow"].dataType
            fields = [F.col("flow.honeypot").alias("honeypot") if f.name == "honeypot"
                      else F.lit(None).cast(f.dataType).alias(f.name) for f in full]
            return df.withColumn("flow", F.struct(*fields))
        return df
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [widened(p) for p in parts])


def encode(events: DataFrame) -> DataFrame:
    """`value`: the JSON line, without null fields; `type` and `day` stay as partition columns."""
    fields = [c for c in events.columns]
    return events.select(F.to_json(F.struct(*fields)).alias("value"), "type",
                         F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day"))


def append(events: DataFrame, path: str) -> None:
    encode(events).write.mode("append").partitionBy("type", "day").text(path)


def decode(lines: DataFrame, schema: str = EVENT, keep: list[str] = ()) -> DataFrame:
    """Lines that are complete JSON records; blank and malformed lines are skipped."""
    parsed = F.from_json("value", schema + ", _bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (lines.filter(F.trim("value") != "").select(*keep, parsed.alias("e"))
            .filter("e IS NOT NULL AND e._bad IS NULL").select(*keep, "e.*").drop("_bad"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))


def recent(lines: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The limit counts lines; bad lines among them are dropped afterwards."""
    newest = lines.orderBy(*[F.desc(c) for c in order]).limit(limit)
    return decode(newest, keep=order)


def scan_feature_rows(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One feature object per line; blank lines are skipped and a malformed line fails the job."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FEATURE_ROW).option("mode", "FAILFAST").json(path)
