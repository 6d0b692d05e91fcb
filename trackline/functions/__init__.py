"""Column expressions shared by the operators. All run inside generated JVM code."""

from trackline.functions.numeric import comma_double, delay_minutes, integer, number, speed_value, to_double
from trackline.functions.temporal import epoch_timestamp, hour_of_day, month_of_year, parse_timestamp, time_bucket, weekday
from trackline.functions.text import (
    STRICT_YES,
    UNANCHORED_YES,
    is_yes,
    label,
    sanitize_names,
    sanitize_name,
    sanitized,
    strip,
)

__all__ = [
    "STRICT_YES",
    "UNANCHORED_YES",
    "comma_double",
    "delay_minutes",
    "epoch_timestamp",
    "hour_of_day",
    "integer",
    "is_yes",
    "label",
    "month_of_year",
    "number",
    "parse_timestamp",
    "sanitize_name",
    "sanitize_names",
    "sanitized",
    "speed_value",
    "strip",
    "time_bucket",
    "to_double",
    "weekday",
]
