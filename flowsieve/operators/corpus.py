"""Labelled flow corpus: cleaning, caps, splits, statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.labels import binary_label, to_number
from flowsieve.operators.features import long_stats
from flowsieve.operators.selection import cap_per_group, quantiles
from flowsieve.schemas import BENIGN, CORPUS_COLUMNS, FEATURES


def projected(raw: DataFrame, *keep: str) -> DataFrame:
    """Only the eleven mapped columns, under their feature names, and the label."""
    return raw.select(*keep, *[F.col(column).alias(feature) for feature, column in CORPUS_COLUMNS.items()], "Label")


def clean(raw: DataFrame, *keep: str) -> DataFrame:
    """Feature matrix: numbers only; text, NaN and infinities become null."""
    return projected(raw, *keep).select(
        *keep, *[to_number(F.col(f)).alias(f) for f in FEATURES], binary_label(F.col("Label")).alias("label"))


def capped(rows: DataFrame, cap: int = 40_000, file: str = "source_file", label: str = "label") -> DataFrame:
    """The cap counts per file and class."""
    return cap_per_group(rows, [file, label], cap)


def summary(raw: DataFrame, file: str = "source_file") -> DataFrame:
    """Rows, benign and anomaly per file, and the total row with a null file."""
    label = binary_label(F.col("Label"))
    return (raw.select(file, label.alias("label")).rollup(file)
            .agg(F.count("*").alias("rows"), F.count_if(F.col("label") == BENIGN).alias("benign"))
            .withColumn("anomaly", F.col("rows") - F.col("benign")))


def sample(rows: DataFrame, per_group: int = 4, file: str = "source_file") -> DataFrame:
    """Up to four benign and four attack rows of every file."""
    return cap_per_group(rows, [file, "label"], per_group)


def class_weights(labels: DataFrame) -> DataFrame:
    """Benign over anomaly (boosting) and balanced n / (2 n_class) weights (forest)."""
    n = labels.agg(F.count_if(F.col("label") == BENIGN).alias("benign"),
                   F.count_if(F.col("label") != BENIGN).alias("anomaly"))
    at_least = lambda c: F.greatest(F.col(c), F.lit(1))
    total = F.col("benign") + F.col("anomaly")
    return n.select("benign", "anomaly", (F.col("benign") / at_least("anomaly")).alias("positive_weight"),
                    (total / (2 * at_least("benign"))).alias("benign_weight"),
                    (total / (2 * at_least("anomaly"))).alias("anomaly_weight"))


def median_fit(rows: DataFrame, names: list[str] = FEATURES, small_rows: int = 2_000_000) -> dict[str, float]:
    """Exact medians; a column without any number gets 0."""
    return {c: 0.0 if v is None else v for c, v in quantiles(rows, names, 0.5, small_rows).items()}


def imputed(name: str, medians: dict[str, float]) -> Column:
    x = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(float(medians[name])))


def standard_fit(rows: DataFrame, names: list[str] = FEATURES, small_rows: int = 2_000_000) -> DataFrame:
    """Per feature: median, and mean and population deviation after imputation."""
    medians = median_fit(rows, names, small_rows)
    wide = rows.agg(*[f for n in names for f in (
        F.lit(float(medians[n])).alias(f"{n}__median"), F.avg(imputed(n, medians)).alias(f"{n}__mean"),
        F.stddev_pop(imputed(n, medians)).alias(f"{n}__deviation"))])
    return long_stats(wide, names, ["median", "mean", "deviation"])


def standard_apply(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(x or median - mean) / deviation; a constant feature is only centred.

    The statistics are one row per feature and enter the plan as constants.
    """
    fitted = {r["feature"]: r for r in stats.collect()}
    medians = {f: r["median"] for f, r in fitted.items()}
    return rows.withColumns({
        f: (imputed(f, medians) - F.lit(r["mean"])) / F.lit(r["deviation"] or 1.0) for f, r in fitted.items()})
