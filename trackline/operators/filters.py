"""Row filters. All are plain predicates, so they reach the scan where types allow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackline.functions import delay_minutes
from trackline.operators.stations import MASTER_LISTS

# The map window and the default delay range in minutes.
LAT_RANGE = (27.0, 44.5)
LON_RANGE = (-19.5, 5.5)
DELAY_RANGE = (0, 180)


def value_in(df: DataFrame, column: str, values: Sequence[str] | None, empty_means: str = "all") -> DataFrame:
    """Keep rows whose text is one of ``values``; an empty choice keeps all or none."""
    if empty_means not in ("all", "none"):
        raise ValueError("empty_means is 'all' or 'none'")
    if not values:
        return df if empty_means == "all" else df.filter(F.lit(False))
    if column not in df.columns:
        return df
    return df.filter(F.col(column).cast("string").isin(*values))


def map_layer(stations: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Stations of the chosen map layers; no choice shows none."""
    return value_in(stations, "source", sources, empty_means="none")


def delay_between(updates: DataFrame, low: float = DELAY_RANGE[0], high: float = DELAY_RANGE[1]) -> DataFrame:
    """Delays in minutes within both ends; missing delays go."""
    return updates.filter(delay_minutes(F.col("delay_seconds")).between(low, high))


def in_map_window(points: DataFrame) -> DataFrame:
    return points.filter(F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE))


def nonzero_coords(points: DataFrame) -> DataFrame:
    return points.filter((F.col("lat") != 0) & (F.col("lon") != 0))


def business_filters(
    bundle: dict[str, DataFrame],
    provinces: Sequence[str] = (),
    feeds: Sequence[str] = (),
    route_types: Sequence[str] = (),
    vehicle_statuses: Sequence[str] = (),
    delay_range: tuple[float, float] = DELAY_RANGE,
    station_sources: Sequence[str] = (),
    constructors: Sequence[str] = (),
    two_lists_only: bool = False,
) -> dict[str, DataFrame]:
    """Apply every user choice to the bundle; an empty choice filters nothing.

    Station choices apply to all four lists, or with ``two_lists_only`` just to the
    first two.
    """
    out = dict(bundle)
    for name in MASTER_LISTS[:2] if two_lists_only else MASTER_LISTS:
        if name in out:
            out[name] = value_in(value_in(out[name], "province", provinces), "source", station_sources)
    if "trip_updates" in out:
        out["trip_updates"] = delay_between(value_in(out["trip_updates"], "feed", feeds), *delay_range)
    for name, column, values in (
        ("gtfs_routes", "route_type", route_types),
        ("vehicles", "status", vehicle_statuses),
        ("train_info", "constructor", constructors),
    ):
        if name in out:
            out[name] = value_in(out[name], column, values)
    return out
