"""The eleven-feature record of a flow, and min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.flows import flow_totals
from flowsieve.schemas import FEATURES

SHORTEST = 1e-6  # seconds; replaces any duration that is not longer


def extract(flows: DataFrame) -> DataFrame:
    """Adds the eleven features to each flow; protocol and dst_port are already there."""
    seconds = F.col("duration_us") / F.lit(1e6)
    return flow_totals(flows).withColumns({
        "flow_duration": seconds,
        "total_fwd_packets": F.col("fwd_packets"), "total_bwd_packets": F.col("bwd_packets"),
        "total_fwd_bytes": F.col("fwd_bytes"), "total_bwd_bytes": F.col("bwd_bytes"),
        "packets_per_second": F.col("total_packets") / F.when(seconds > SHORTEST, seconds).otherwise(SHORTEST)})


def vector(columns: list[str] = FEATURES) -> Column:
    return F.array(*[F.col(name).cast("double") for name in columns])


def with_defaults(rows: DataFrame) -> DataFrame:
    """Features that are absent (no column, or null) become 0.0; NaN is kept for the imputer."""
    have = dict(rows.dtypes)
    filled = {name: F.coalesce(F.col(name), F.lit(0).cast(have[name])) if name in have else F.lit(0.0)
              for name in FEATURES}
    return rows.withColumns(filled)


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def long_stats(wide: DataFrame, names: list[str], stats: list[str]) -> DataFrame:
    """One-row frame with `feature__stat` columns to one row per feature."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"),
                              *[F.col(f"{n}__{s}").cast("double").alias(s) for s in stats])
                     for i, n in enumerate(names)])
    return wide.select(F.inline(rows))


def minmax_fit(rows: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    aggregates = [f(_number(n)).alias(f"{n}__{s}") for n in names for s, f in (("low", F.min), ("high", F.max))]
    return long_stats(rows.agg(*aggregates), names, ["low", "high"])


def minmax_apply(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - low) / (high - low); a constant feature gives 0, one without numbers null; values outside the fit are not clipped.

    The fitted statistics are one row per feature, so they enter the plan as constants.
    """
    scaled = {}
    for row in stats.collect():
        if row["low"] is None:   # no number was seen, so none can be scaled
            scaled[row["feature"]] = F.lit(None).cast("double")
            continue
        span = row["high"] - row["low"]
        x = F.col(row["feature"]).cast("double")
        scaled[row["feature"]] = (x - F.lit(row["low"])) / F.lit(span if span != 0 else 1.0)
    return rows.withColumns(scaled)


def preview(rows: DataFrame, n: int = 6) -> DataFrame:
    """First flows in time order, raw and scaled side by side."""
    first = rows.orderBy("start_us", "flow_id").limit(n)
    scaled = minmax_apply(first, minmax_fit(rows))
    return (first.select("flow_id", "start_us", *[F.col(n).cast("double").alias(n) for n in FEATURES])
            .join(scaled.select("flow_id", *[F.col(n).alias(f"{n}_scaled") for n in FEATURES]), "flow_id"))


def save_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_stats(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
