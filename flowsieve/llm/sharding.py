"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a number for a key, -ln(u) / weight with u from a hash of key and shard, and the
least draw wins. A key's draws don't depend on the other shards, so one more shard takes keys only into
itself, and taking one away moves only its own keys. Assigning is an expression without a shuffle.

Slots number a shard's rows without gaps. Rows are counted in small hash buckets of every shard, equal rows once with
their number, so that neither a shard nor a key that holds a third of all rows is ordered in one task.

Cases with a defined result: null keys count as one key of their own; a null or empty text has size 1 (the
end mark) and crc 0; equal rows take adjacent slots; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import utf8_crc32
from flowsieve.session import settle

BUCKETS = 1024


def key_text(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(key.cast("string"), F.lit(""))


def hash_bits(text: Column, bits: int = 52) -> Column:
    """The first bits of the MD5 of a text as a number; the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def shard(key: str | Column, weights: list[float]) -> Column:
    """The number of the shard that wins the key."""
    text = key_text(key)
    draws = []
    for number, weight in enumerate(weights):
        u = (hash_bits(F.concat(F.lit(f"{number}:"), text)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(number).alias("shard")))
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["shard"]


def slots(rows: DataFrame, shard_column: str, key: str | Column) -> DataFrame:
    """Adds `slot`, gapless from 0 in every shard: by hash bucket of the row, then by the row itself.

    `rows` should be narrow: equal rows are counted together and multiplied again.
    """
    columns = rows.columns
    text = F.concat_ws(":", key_text(key), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c != key])
    grouped = settle(rows.groupBy(*columns).agg(F.count("*").alias("_n"))
                     .withColumn("_bucket", F.pmod(hash_bits(text, 28), F.lit(BUCKETS)).cast("int")))
    before = Window.partitionBy(shard_column).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (grouped.groupBy(shard_column, "_bucket").agg(F.sum("_n").alias("_rows"))
              .select(shard_column, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(shard_column, "_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = grouped.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    # shards times buckets rows: a bounded table
    placed = numbered.join(F.broadcast(starts), [shard_column, "_bucket"])
    first = F.col("_start") + F.col("_before")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def assigned(docs: DataFrame, weights: list[float], more: list[float] | None = None, *, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The rows with size, text_crc32, shard and, for a second list of weights, grown_shard. No shuffle."""
    added = ["size", "text_crc32", "shard", "grown_shard"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    grown = shard(key, more) if more else F.lit(None).cast("int")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return (docs.withColumn("size", size).withColumn("text_crc32", utf8_crc32(F.col(text)))
            .withColumn("shard", shard(key, weights)).withColumn("grown_shard", grown))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard."""
    rows.write.partitionBy("shard").parquet(path)
