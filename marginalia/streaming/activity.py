"""Activity as a stream: counts by day and route with a bound on lateness. An extension beyond the batch dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_routes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Jobs by day and route; rows later than `late` behind the latest are dropped, so state stays bounded."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("route_type"))
    days = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "route_type").agg(F.count("*").alias("n"))
    return days.select(F.col("w.start").cast("date").alias("day"), "route_type", "n")
