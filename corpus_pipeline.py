"""From documents to token ids: quality rules, near-duplicate removal, secret redaction, mixing, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. run() writes every stage as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import bpe, mixing, quality_rules, secrets_scan, shingle_join
from flowsieve.llm.common import bounded_batches, packed, table
from flowsieve.llm.queries import MIX_CAP, MIX_SHARE, MIX_WEIGHTS, tokenizer
from flowsieve.session import scratch_path

#: Near duplicates of the stage; op8_shingle_join has a contract of its own, 4 words and 85 %.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    bounded_batches(spark)
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest id; links are pairs with NEAR_PERCENT % of common NEAR_WORDS-word shingles."""
    bounded_batches(spark)
    return shingle_join.representatives(docs, NEAR_WORDS, NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text where it has changed."""
    clean = secrets_scan.redacted(docs.withColumn("_before", F.xxhash64("text")))
    n_chars = F.when(F.col("_before") == F.xxhash64("text"), F.col("n_chars")).otherwise(F.length("text"))
    return clean.withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows = packed(docs).select("_row", "_row.doc_id", "_row.text", "_row.source")
    return mixing.repeated(mixing.mix(rows, MIX_WEIGHTS, MIX_SHARE, MIX_CAP)).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    bounded_batches(spark)
    return bpe.digests(docs, tokenizer(), with_ids=True)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mix),
          ("token ids", encode)]
#: Regular-expression windows, hashed draws and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
