"""Traffic readings as a stream: a projection without state, the same on a table and on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions.scalars import traffic_level


def classify_readings(readings: DataFrame) -> DataFrame:
    """readings(current_speed, free_flow_speed, current_travel_time, free_flow_travel_time, road_closure, ...) with nivel and demora."""
    level = traffic_level(F.col("current_speed"), F.col("free_flow_speed"), F.coalesce("road_closure", F.lit(False)))
    return readings.withColumn("nivel", level).withColumn("demora", F.col("current_travel_time") - F.col("free_flow_travel_time"))
