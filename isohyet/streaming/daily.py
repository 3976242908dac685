"""The daily table from a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(readings: DataFrame, keys: list[str], time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """keys, date, n, mean, high, low, total of each day, once its watermark has passed; readings later than ``late`` are left out.

    State is one row of sums for each open key and day, whatever the number of readings.
    """
    return (
        readings.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"), F.min(value).alias("low"), F.sum(value).alias("total"))
        .select(*keys, F.to_date("window.start").alias("date"), "n", "mean", "high", "low", "total")
    )
