"""Risk classes and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percentile from which each class holds. Fixed values.
CLASSES = ((80, "Very High", 4), (60, "High", 3), (40, "Medium", 2), (20, "Low", 1))


def risk_class(percentile: Column) -> Column:
    out = F.when(percentile.isNull(), "Unknown")
    for least, name, _ in CLASSES:
        out = out.when(percentile >= least, name)
    return out.otherwise("Very Low")


def risk_code(percentile: Column) -> Column:
    out = F.when(percentile.isNull(), F.lit(None).cast("int"))
    for least, _, code in CLASSES:
        out = out.when(percentile >= least, code)
    return out.otherwise(0)


def delta(current: Column, baseline: Column) -> Column:
    return current - baseline


def delta_pct(current: Column, baseline: Column) -> Column:
    """Per cent of the baseline; null where that is 0."""
    return (current - baseline) / F.nullif(baseline, F.lit(0.0)) * 100


def bin_values(value: Column, low: Column, high: Column, bins: int = 15) -> Column:
    """Place of a value in equal bins over [low, high], clipped at both ends; null stays null."""
    width = F.nullif((high - low) / bins, F.lit(0.0))
    return F.when(value.isNotNull(), F.least(F.greatest(F.coalesce(F.floor((value - low) / width), F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int"))


def bin_values_unpadded(value: Column, low: Column, high: Column, bins: int = 15) -> Column:
    """bin_values over a range that may have no extent: then values from it on are in the last bin, those below it in the first."""
    return F.when((low == high) & (value >= low), F.lit(bins - 1)).otherwise(bin_values(value, low, high, bins))
