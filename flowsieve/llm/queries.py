"""The registered queries of the operators over the test tables, and the tokenizer files they use."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import (alignment, bpe, language, mixing, page_text, quality_model, quality_rules, resampling, secrets_scan, sharding,
                           shingle_join, token_files, vector_join)
from flowsieve.llm.common import bounded_batches, table
from flowsieve.llm.resampling_sql import RESAMPLING
from flowsieve.session import scratch_path

#: The weights of sources in code point order, repeating, and the share of all words in the mix.
MIX_WEIGHTS, MIX_SHARE, MIX_CAP = [3, 1, 2], 1.5, 2.0
END_ID = 2


def tokenizer() -> bpe.Tokenizer:
    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_CAP)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assigned(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard")
    return sharding.slots(placed, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = scratch_path(spark, "tokens")
    token_files.write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.documents(token_files.read_files(spark, path))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op6_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return shingle_join.similar(table(spark, sf_dir, "documents"), 4, 85)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extracted(pages)


def op10_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.report(table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    docs = docs.withColumn("held_out", remainder == 2)
    return language.identify(docs, language.fit(docs, ~F.col("held_out")), ["doc_id", "held_out"])


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1, most=1, buckets=10_000,
                                percent=10, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mixing, op2_quality_model, op3_sharding, op4_token_files, op5_bpe, op6_vector_join, op7_quality_rules, op8_shingle_join,
    op9_page_text, op10_secrets_scan, op11_language, op12_resampling, op13_alignment, pipeline)}
ORACLES: dict[str, str] = {"op12_resampling": RESAMPLING}
