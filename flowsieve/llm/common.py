"""Helpers shared by the operators: columns, words, and small tables."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import settle

#: What separates words, and what a word is.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most this many narrow rows may be copied to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_crc32(text: str | Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def uniform(*columns: str | Column, seed: int) -> Column:
    """A reproducible draw in (0, 1) from the values of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def held_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table with a broadcast hint when counting shows that it is small; else a plain join side."""
    kept = settle(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `_row`, so that no column added later can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def worker_memory() -> dict:
    """A dictionary that lives as long as the Python process, so that a worker's later tasks find what earlier ones kept.

    Functions travel to the workers by value, and so do their module's variables; an own module does not.
    """
    held = sys.modules.setdefault("_flowsieve_worker_memory", types.ModuleType("_flowsieve_worker_memory"))
    return held.__dict__.setdefault("kept", {})


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the system; else it stays with the worker for all later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc has it
    if trim:
        trim(0)


#: Rows and bytes of an Arrow batch: with whole texts in it, 10,000 rows are tens of megabytes on both sides of a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 24
#: Rows of a batch of the Parquet reader, whose column buffers are single arrays on the heap.
READ_ROWS = 512
#: Bytes of a row group that a Parquet writer holds on the heap; Parquet's own bound is 128 MB a task.
GROUP_BYTES = 1 << 24


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches, Parquet batches and row groups below these bounds; smaller Arrow batches that are set already stay."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS if rows <= 0 else min(rows, BATCH_ROWS)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))


def per_text(batches: Iterable[pd.DataFrame], each: Callable[[pd.DataFrame], pd.DataFrame],
             rows: int = 500) -> Iterator[pd.DataFrame]:
    """Applies a function to slices of the batches, so that no large output frame builds up."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield each(batch.iloc[start:start + rows])


def text_slices(texts: pd.Series, rows: int = 200, chars: int = 400_000) -> Iterator[slice]:
    """Slices of at most `rows` texts and about `chars` characters; a longer text is a slice of its own."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        size = len(text) if isinstance(text, str) else 0
        if at > start and (at - start >= rows or held + size > chars):
            yield slice(start, at)
            start, held = at, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))
