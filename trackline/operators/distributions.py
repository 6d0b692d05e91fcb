"""Distributions: severity mix, hourly means, histograms, box statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackline.functions import delay_minutes, hour_of_day, label, speed_value
from trackline.operators.quantiles import approximate_box, box_statistics

# Right-closed delay ranges in minutes and their labels.
SEVERITY_EDGES = [-1, 0, 5, 15, 30, 10_000]
SEVERITY_LABELS = ["On time", "0-5 min", "5-15 min", "15-30 min", "30+ min"]


def _filled_minutes(digits: int | None = None) -> Column:
    return delay_minutes(F.coalesce(F.col("delay_seconds"), F.lit(0.0)), digits)


def severity_rank(minutes: Column) -> Column:
    """Index of the range holding ``minutes``; null outside all ranges."""
    rank = F.when(minutes <= SEVERITY_EDGES[0], None)
    for i, high in enumerate(SEVERITY_EDGES[1:]):
        rank = rank.when(minutes <= high, i)
    return rank


def severity_mix(updates: DataFrame) -> DataFrame:
    """Updates per severity with their share; ranges nobody falls into count 0."""
    counted = (
        updates.groupBy(severity_rank(_filled_minutes()).alias("rank"))
        .agg(F.count(F.lit(1)).alias("trips"))
        .filter(F.col("rank").isNotNull())
    )
    ranges = updates.sparkSession.createDataFrame(list(enumerate(SEVERITY_LABELS)), "rank int, severity string")
    total = counted.agg(F.sum("trips")).scalar()
    trips = F.coalesce(F.col("trips"), F.lit(0).cast("bigint"))
    return ranges.join(counted, "rank", "left").select(
        "rank", "severity", trips.alias("trips"), (trips / total).alias("share")
    )


def delay_by_hour(updates: DataFrame) -> DataFrame:
    """Mean of the rounded delay minutes per hour of day; -1 is no timestamp."""
    return (
        updates.groupBy(hour_of_day(F.col("timestamp"), -1).alias("hour"))
        .agg(F.avg(_filled_minutes(2)).alias("delay_min"))
        .orderBy("hour")
    )


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width histogram between the extremes of ``value``; empty bins are left out.

    The extremes are one scalar; counting combines on the map side, so nothing larger
    than groups x bins is shuffled.
    """
    rows = df.filter(F.col(value).isNotNull())
    extent = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    keys = [by] if by else []
    x, lo, hi = F.col(value), F.col("extent.lo"), F.col("extent.hi")
    position = F.floor(F.lit(bins) * (x - lo) / F.nullif(hi - lo, F.lit(0.0))).cast("int")
    bin_no = F.when(lo == hi, 0).otherwise(F.least(position, F.lit(bins - 1)))
    width = (hi - lo) / bins
    return (
        rows.select(*keys, x, extent.alias("extent"))
        .groupBy(*keys, "extent", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            "bin",
            (lo + F.col("bin") * width).alias("bin_start"),
            (lo + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
    )


def delay_histogram(updates: DataFrame, bins: int = 30) -> DataFrame:
    minutes = updates.select(label(F.col("feed")).alias("feed"), _filled_minutes().alias("delay_min"))
    return histogram(minutes, "delay_min", bins, by="feed")


def alert_histogram(alerts: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(alerts.select(F.col("route_count").cast("double")), "route_count", bins)


def speed_histogram(trains: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(trains.select(speed_value(F.col("velocidad_maxima")).alias("speed")), "speed", bins)


# The quartiles of the box plots.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def minutes_by_feed(updates: DataFrame) -> DataFrame:
    """Delay in minutes per feed."""
    return updates.select(label(F.col("feed")).alias("feed"), _filled_minutes().alias("delay_min"))


def delay_box(updates: DataFrame) -> DataFrame:
    """Box statistics of delay minutes per feed."""
    return box_statistics(minutes_by_feed(updates), "feed", "delay_min")


def delay_box_approx(updates: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Approximate box statistics of delay minutes per feed, for tables too large for exact ones: one small shuffle."""
    return approximate_box(minutes_by_feed(updates), "feed", "delay_min", accuracy)


def delay_box_overall(updates: DataFrame) -> DataFrame:
    """Box statistics over all feeds."""
    # Not a plain constant: the optimizer would drop it as a join key and nest loops.
    everything = F.when(_filled_minutes().isNotNull(), F.lit("all"))
    minutes = updates.select(everything.alias("feed"), _filled_minutes().alias("delay_min"))
    return box_statistics(minutes, "feed", "delay_min")
