"""Labelled CSV corpora: `*_cleaned.csv` files (or folders of that name) with a header."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.selection import draw
from flowsieve.schemas import CORPUS
from flowsieve.session import settle

PATTERN = "*_cleaned.csv"


def scan_csv(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """All matching files with their name in `source_file`; fails when there is none.

    Columns are found by name: files with the same header are read together, and the reads are united. Further columns
    are left out, a missing feature is null, and a missing label is an error. The parts of a folder share one header;
    Spark fails on a part that differs. Every column is read as text; numbers are parsed where they are
    used, so a bad value becomes a missing one instead of failing the scan.
    """
    path = os.path.join(folder, pattern)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for status in found:
        file = status.getPath().toString()
        by_header.setdefault(tuple(spark.read.option("header", True).csv(file).columns), []).append(file)
    by_header.pop((), None)     # files without even a header
    if not by_header:
        return spark.createDataFrame([], T.StructType([*CORPUS.fields, T.StructField("source_file", T.StringType())]))
    return reduce(DataFrame.unionByName, [_aligned(spark, files) for files in by_header.values()])


def _aligned(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files with one header, with the columns of the corpus in its order."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(files)  # no type inference
    have = {c.strip(): c for c in raw.columns}
    if "Label" not in have:
        raise ValueError(f"no column Label in {files[0]}")
    wanted = [F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None).cast("string") for f in CORPUS.fields]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+_cleaned\.csv)", 1)
    return raw.select(*[c.alias(f.name) for c, f in zip(wanted, CORPUS.fields)], name.alias("source_file"))


def training_rows(spark: SparkSession, folder: str, seed: int = 42, pattern: str = PATTERN) -> DataFrame:
    """The scan with the `row_id` and `draw` that caps and splits need, written once so that all later steps agree.

    A row's id is its place in the scan and its draw a hash of seed, file and id: equal rows are drawn apart.
    """
    rows = scan_csv(spark, folder, pattern).withColumn("row_id", F.monotonically_increasing_id())
    return settle(rows.withColumn("draw", draw(seed, "source_file", "row_id")))


def write_csv(rows: DataFrame, folder: str, file_column: str = "source_file") -> None:
    """One folder per file name, readable by `scan_csv`."""
    rows.write.mode("overwrite").option("header", True).partitionBy(file_column).csv(folder)
