"""Top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackline.functions import delay_minutes


def top_delayed_trips(updates: DataFrame, n: int = 20) -> DataFrame:
    """Most delayed updates, missing delays last; ties go by trip, feed and time."""
    delay = F.when(~F.isnan("delay_seconds"), F.col("delay_seconds"))
    return (
        updates.select("feed", "trip_id", delay.alias("delay_seconds"), "timestamp")
        .orderBy(
            F.desc_nulls_last("delay_seconds"),
            F.asc_nulls_last("trip_id"),
            F.asc_nulls_last("feed"),
            F.asc_nulls_last("timestamp"),
        )
        .limit(n)
        .select("feed", "trip_id", delay_minutes(F.col("delay_seconds"), 1).alias("delay_min"), "timestamp")
    )
