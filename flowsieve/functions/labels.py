"""Label and class helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.schemas import ANOMALY, BENIGN


def binary_label(label: Column) -> Column:
    """BENIGN when the trimmed text says so, else ANOMALY (also for a missing label)."""
    text = F.upper(F.btrim(F.coalesce(label, F.lit("nan")), F.lit(" \t\r\n\f\v")))
    return F.when(text == BENIGN, F.lit(BENIGN)).otherwise(F.lit(ANOMALY))


def to_number(value: Column) -> Column:
    """Numeric value, or null for text that is no number, NaN and infinities."""
    number = value.try_cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number)
