"""The daily table of events through Structured Streaming, read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.plans.catalog import query
from isohyet.sources.adapter import table
from isohyet.sources.io import scratch
from isohyet.streaming.daily import daily_stream


@query("WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, count(value) AS n, max(value) AS high, min(value) AS low FROM events GROUP BY ALL) SELECT event_type, date, n, round(high, 6) AS high, round(low, 6) AS low FROM d WHERE date + INTERVAL 3 DAY <= (SELECT max(ts) FROM events)")
def daily_stream_of_events(spark, d):
    """Days whose watermark has passed when the stream of all events ends."""
    base = table(spark, d, "events")
    out, state = scratch(spark, "daily"), scratch(spark, "daily-state")
    # the stream's source is a folder of files
    feed = scratch(spark, "feed")
    base.select("event_type", "ts", "value").repartition(4).write.parquet(feed)
    stream = daily_stream(spark.readStream.schema("event_type string, ts timestamp, value double").parquet(feed), ["event_type"])
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("event_type", "date", "n", F.col("high"), F.col("low"))
