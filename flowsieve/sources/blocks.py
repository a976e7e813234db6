"""Block list files: a JSON object {address: {blocked_at, expires_at}} or a Parquet snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "map<string, struct<blocked_at:double, expires_at:double>>"


def parse_snapshot(texts: DataFrame) -> DataFrame:
    """Rows of whole-file texts in `value`; a corrupt file gives no rows. Null expiry is permanent."""
    micros = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    return (texts.select(F.explode(F.from_json("value", RECORD)).alias("ip", "r"))
            .select("ip", micros("r.blocked_at").alias("blocked_at_us"), micros("r.expires_at").alias("expires_at_us")))


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_snapshot(spark.read.option("wholetext", True).text(path))


def to_json(blocks: DataFrame) -> DataFrame:
    """One JSON object per address, keyed by it; the importable text form of a snapshot."""
    record = F.struct((F.col("blocked_at_us") / F.lit(1e6)).alias("blocked_at"),
                      (F.col("expires_at_us") / F.lit(1e6)).alias("expires_at"))
    return blocks.select(F.to_json(F.create_map("ip", record), {"ignoreNullFields": "false"}).alias("value"))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
