"""Every report over a dataset bundle, as lazy frames by page.

A report whose columns a dataset does not have is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trackline.functions import STRICT_YES
from trackline.operators import counts, distributions, filters, rankings
from trackline.operators.columns import preview
from trackline.operators.stations import station_master

# Columns the previews show.
FLEET = ["modelo", "constructor", "velocidad_maxima", "plazas_sentadas", "proposito"]
INCIDENT = ["chipText", "aspect", "paragraph", "link"]

# Report, the columns it needs, and how it is built from its dataset.
Report = tuple[str, list[str], Callable[[DataFrame], DataFrame]]

ACCESS_REPORTS: list[Report] = [
    ("accessibility_coverage", [], counts.accessibility_coverage),
    ("accessibility_coverage_strict", [], lambda df: counts.accessibility_coverage(df, pattern=STRICT_YES)),
    ("lead_time", ["tiempo_de_antelacion"], lambda df: counts.with_share(counts.lead_time(df), "count")),
    ("accessibility_preview", [], lambda df: preview(df, df.columns, 50, df.columns)),
]
TRAIN_REPORTS: list[Report] = [
    ("models_by_constructor", ["constructor"], counts.models_by_constructor),
    ("speed_histogram", ["velocidad_maxima"], distributions.speed_histogram),
    ("purpose_mix", ["proposito"], counts.purpose_mix),
    ("fleet_preview", [], lambda df: preview(df, FLEET, 100, [c for c in FLEET if c in df.columns])),
]
UPDATE_REPORTS: list[Report] = [
    ("delay_kpis", ["delay_seconds"], counts.delay_kpis),
    ("delay_histogram", ["delay_seconds", "feed"], distributions.delay_histogram),
    ("top_delayed_trips", ["delay_seconds", "feed", "trip_id", "timestamp"], rankings.top_delayed_trips),
    ("delay_box", ["delay_seconds", "feed"], distributions.delay_box),
    ("delay_box_overall", ["delay_seconds"], distributions.delay_box_overall),
    ("severity_mix", ["delay_seconds"], distributions.severity_mix),
    ("delay_by_hour", ["delay_seconds", "timestamp"], distributions.delay_by_hour),
]
ROUTE_REPORTS: list[Report] = [
    ("service_mix", ["route_short_name"], lambda df: counts.with_share(counts.service_mix(df), "routes")),
    ("top_services", ["route_short_name"], lambda df: counts.service_mix(df, 15)),
    ("route_families", ["route_short_name"], counts.route_families),
]
VEHICLE_REPORTS: list[Report] = [
    ("vehicle_status", ["status"], counts.vehicle_status),
    ("vehicle_status_by_key", ["status"], counts.vehicle_status_by_key),
]
ALERT_REPORTS: list[Report] = [
    ("alert_histogram", ["route_count"], distributions.alert_histogram),
    ("alerts", [], lambda df: preview(df, ["id", "route_count", "description"], None, ["id"])),
]


def _reports(df: DataFrame, reports: list[Report]) -> dict[str, DataFrame]:
    return {name: build(df) for name, needs, build in reports if set(needs) <= set(df.columns)}


def station_pages(bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Overview, map, accessibility and fleet pages."""
    stations, access, trains = station_master(bundle), bundle["atendo"], bundle["train_info"]
    on_map = filters.in_map_window(stations)
    out = {
        "stations_by_province": counts.stations_by_province(stations),
        "map_points": on_map,
        "map_centre": counts.centroid(on_map),
        **_reports(access, ACCESS_REPORTS),
        **_reports(trains, TRAIN_REPORTS),
    }
    if "modelo" in trains.columns:
        out["overview_kpis"] = counts.overview_kpis(stations, access, trains)
    return out


def operations_pages(bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Insight, dashboard, analytics and operations pages over the live data."""
    stations, incidents = bundle["stations"], bundle["incidents"]
    coverage = counts.stations_by_source_province(stations)
    shown = [c for c in incidents.columns if c.lower() in {i.lower() for i in INCIDENT}]
    return {
        "operations_kpis": counts.operations_kpis(bundle),
        "stations_by_raw_province": counts.stations_by_raw_province(stations),
        "network_centre": counts.centroid(stations, bundle["vehicles"]),
        "stations_by_source_province": coverage,
        "source_totals": counts.source_totals(coverage),
        "incident_preview": preview(incidents, INCIDENT, 20, shown),
        **_reports(bundle["trip_updates"], UPDATE_REPORTS),
        **_reports(bundle["gtfs_routes"], ROUTE_REPORTS),
        **_reports(bundle["vehicles"], VEHICLE_REPORTS),
        **_reports(bundle["alerts"], ALERT_REPORTS),
    }


def _filter_columns(bundle: dict[str, DataFrame]) -> list[tuple[DataFrame, list[str]]]:
    """The datasets that user filters take their values from, with the columns of each."""
    found = [
        (station_master(bundle), ["province", "source"]),
        (bundle["train_info"], ["constructor"]),
        (bundle["trip_updates"], ["feed"]),
        (bundle["gtfs_routes"], ["route_type"]),
        (bundle["vehicles"], ["status"]),
    ]
    present = [(df, [c for c in columns if c in df.columns]) for df, columns in found]
    return [(df, columns) for df, columns in present if columns]


def filter_values(bundle: dict[str, DataFrame]) -> DataFrame:
    """(filter, value): the values of every user filter, sorted; one aggregate per dataset and one sort in all."""
    rows = [counts.distinct_values(df, columns) for df, columns in _filter_columns(bundle)]
    return reduce(DataFrame.unionByName, rows).orderBy("filter", "value")


def filter_choices(bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sorted values per user filter, each to be read on its own."""
    return {
        name: counts.distinct_values(df, [name]).select(F.col("value").alias(name)).orderBy(name)
        for df, columns in _filter_columns(bundle)
        for name in columns
    }


def inventory_pages(inventory: DataFrame) -> dict[str, DataFrame]:
    """Table inventory page."""
    return {
        "inventory_kpis": counts.inventory_kpis(inventory),
        "tables_by_domain": counts.tables_by_domain(inventory),
        "tables": inventory,
    }
