"""Timestamps and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType


def epoch_timestamp(text: Column) -> Column:
    """Epoch seconds held as text; null when not an integer."""
    return F.timestamp_seconds(text.try_cast("bigint"))


def parse_timestamp(df: DataFrame, name: str | None) -> Column:
    """A column as timestamp; unparsable text becomes null, numbers are epoch nanoseconds."""
    if name is None:
        return F.lit(None).cast("timestamp")
    col = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return col.cast("timestamp")
    if isinstance(kind, NumericType):
        return F.timestamp_micros(F.floor(col / F.lit(1000)).cast("bigint"))
    return F.try_to_timestamp(col.cast("string"))


def hour_of_day(ts: Column, missing: int) -> Column:
    return F.coalesce(F.hour(ts), F.lit(missing))


def weekday(ts: Column, missing: int = 0) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(ts), F.lit(missing))


def month_of_year(ts: Column, missing: int = 1) -> Column:
    return F.coalesce(F.month(ts), F.lit(missing))


def time_bucket(hour: Column) -> Column:
    """Part of the day for an hour 0-23."""
    return (
        F.when(hour <= 5, "night").when(hour <= 11, "morning").when(hour <= 17, "afternoon").otherwise("evening")
    )
