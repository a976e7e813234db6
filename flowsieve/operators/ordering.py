"""Neighbour lookups in a group's time order that never bring a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next_time(rows: DataFrame, group: list[str], time: str, tie: str, width: int, name: str) -> DataFrame:
    """Adds the time of the next row of the group in (time, tie) order.

    Rows are ordered inside (group, slice of `width`); the last row of a slice takes the first time
    of the group's next slice, found over one summary row per slice.
    """
    rows = rows.withColumn("_slice", F.floor(F.col(time) / F.lit(width)).cast("bigint"))
    inside = Window.partitionBy(*group, "_slice").orderBy(time, tie)
    slices = Window.partitionBy(*group).orderBy("_slice")
    onward = (rows.groupBy(*group, "_slice").agg(F.min(time).alias("_first"))
              .select(*group, "_slice", F.lead("_first").over(slices).alias("_far")))
    return (rows.withColumn("_near", F.lead(time).over(inside))
            .join(onward, group + ["_slice"])
            .withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_slice"))
