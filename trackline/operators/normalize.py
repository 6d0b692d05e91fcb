"""Canonical datasets from loosely named tables.

Each function resolves column aliases while the plan is built and emits one fixed
schema. Missing text stays null; a dataset without its key columns is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackline import schemas
from trackline.functions import comma_double, integer, number, parse_timestamp, strip
from trackline.operators.columns import pick_column
from trackline.operators.filters import nonzero_coords

# Accepted spellings per field, in order of preference.
TRIP_ID = ["trip_id", "tripid", "id"]
DELAY = ["delay_seconds", "delay_sec", "delay", "delay_min", "delay_minutes"]
TIMESTAMP = ["timestamp", "event_time", "ts", "datetime"]
FEED = ["feed", "service", "line"]
LATITUDE = ["lat", "latitude", "stop_lat", "latitud"]
LONGITUDE = ["lon", "lng", "longitude", "stop_lon", "longitud"]
STATION_CODE = ["station_code", "stop_id", "id", "code", "codigo", "codigo_de_estacion"]
STATION_NAME = ["station_name", "stop_name", "name", "point_name", "descripcion", "nombre_de_la_estacion"]
PROVINCE = ["province", "region", "state", "provincia"]
SOURCE = ["source", "feed", "dataset"]
ENTITY_ID = ["entity_id", "id"]
VEHICLE_ID = ["vehicle_id", "id_vehiculo", "veh_id"]
VEHICLE_LABEL = ["vehicle_label", "label", "name"]
STATUS = ["status", "current_status"]
STOP_ID = ["stop_id", "station_code"]
ROUTE_ID = ["route_id", "id"]
ROUTE_NAME = ["route_short_name", "service", "route_name", "line"]
ROUTE_TYPE = ["route_type", "type"]
ALERT_ID = ["id", "alert_id"]
ROUTE_COUNT = ["route_count", "affected_routes"]
DESCRIPTION = ["description", "text", "message"]
CSV_CODE = ["CODIGO", "CÓDIGO", "CODIGO DE ESTACIÓN"]
CSV_NAME = ["DESCRIPCION", "NOMBRE DE LA ESTACION"]


def _text(df: DataFrame, options: list[str], default: str | None = "") -> Column:
    name = pick_column(df, options)
    return F.lit(default).cast("string") if name is None else F.col(f"`{name}`").cast("string")


def normalize_trip_updates(df: DataFrame, keep_entity_id: bool = False) -> DataFrame:
    """Trip updates with a delay in seconds; a delay column named in minutes is scaled.

    ``entity_id`` is null as in warehouse results unless ``keep_entity_id`` is set.
    """
    trip, delay = pick_column(df, TRIP_ID), pick_column(df, DELAY)
    if trip is None or delay is None:
        return schemas.empty(df.sparkSession, schemas.TRIP_UPDATES)
    seconds = number(df, delay)
    if "min" in delay.lower():
        seconds = seconds * F.lit(60.0)
    entity = _text(df, ["entity_id"], None) if keep_entity_id else F.lit(None).cast("string")
    return df.select(
        _text(df, FEED, "Warehouse").alias("feed"),
        entity.alias("entity_id"),
        F.col(f"`{trip}`").cast("string").alias("trip_id"),
        seconds.alias("delay_seconds"),
        parse_timestamp(df, pick_column(df, TIMESTAMP)).alias("timestamp"),
    ).filter(F.col("delay_seconds").isNotNull())


def normalize_geo_points(df: DataFrame) -> DataFrame:
    """Stations or stops with numeric coordinates."""
    lat, lon = pick_column(df, LATITUDE), pick_column(df, LONGITUDE)
    if lat is None or lon is None:
        return schemas.empty(df.sparkSession, schemas.STATIONS)
    return df.select(
        _text(df, STATION_CODE).alias("station_code"),
        _text(df, STATION_NAME, "Warehouse point").alias("station_name"),
        number(df, lat).alias("lat"),
        number(df, lon).alias("lon"),
        _text(df, PROVINCE).alias("province"),
        _text(df, SOURCE, "Warehouse SQL").alias("source"),
    ).dropna(subset=["lat", "lon"])


def normalize_vehicles(df: DataFrame) -> DataFrame:
    """Vehicle positions with numeric coordinates."""
    lat, lon = pick_column(df, LATITUDE[:2]), pick_column(df, LONGITUDE[:3])
    if lat is None or lon is None:
        return schemas.empty(df.sparkSession, schemas.VEHICLES)
    return df.select(
        _text(df, ENTITY_ID).alias("entity_id"),
        _text(df, TRIP_ID[:2]).alias("trip_id"),
        _text(df, VEHICLE_ID).alias("vehicle_id"),
        _text(df, VEHICLE_LABEL).alias("vehicle_label"),
        _text(df, STATUS).alias("status"),
        _text(df, STOP_ID).alias("stop_id"),
        number(df, lat).alias("lat"),
        number(df, lon).alias("lon"),
    ).dropna(subset=["lat", "lon"])


def normalize_routes(df: DataFrame) -> DataFrame:
    return df.select(
        _text(df, ROUTE_ID).alias("route_id"),
        _text(df, ROUTE_NAME, "Unknown").alias("route_short_name"),
        _text(df, ROUTE_TYPE, "Unknown").alias("route_type"),
    )


def normalize_scheduled_trips(df: DataFrame) -> DataFrame:
    """Scheduled trips; without a known key name the first column is the key."""
    key = pick_column(df, TRIP_ID) or df.columns[0]
    return df.select(
        F.col(f"`{key}`").cast("string").alias("trip_id"),
        _text(df, ["route_id"]).alias("route_id"),
        integer(df, pick_column(df, ["direction_id"])).alias("direction_id"),
    )


def normalize_alerts(df: DataFrame) -> DataFrame:
    return df.select(
        _text(df, ALERT_ID).alias("id"),
        integer(df, pick_column(df, ROUTE_COUNT)).alias("route_count"),
        _text(df, DESCRIPTION).alias("description"),
    )


def normalize_station_csv(df: DataFrame, source: str, drop_zero: bool = True) -> DataFrame:
    """Station list with Spanish headers and decimal commas."""
    lat = comma_double(_text(df, ["LATITUD"], None))
    lon = comma_double(_text(df, ["LONGITUD"], None))
    points = df.select(
        strip(_text(df, CSV_CODE, None)).alias("station_code"),
        strip(_text(df, CSV_NAME, None)).alias("station_name"),
        lat.alias("lat"),
        lon.alias("lon"),
        strip(_text(df, ["PROVINCIA"], None)).alias("province"),
        F.lit(source).alias("source"),
    ).dropna(subset=["lat", "lon"])
    return nonzero_coords(points) if drop_zero else points


def normalize_stops(df: DataFrame) -> DataFrame:
    """Schedule stops: coordinates become numbers, every other column is kept."""
    return df.withColumns({c: number(df, c) for c in ("stop_lat", "stop_lon") if c in df.columns})


def project_station_list(df: DataFrame, source: str) -> DataFrame:
    """Bronze station table to the canonical columns with a constant source tag."""
    return df.select(
        _text(df, ["codigo", "c_digo"], None).alias("station_code"),
        _text(df, ["descripcion"], None).alias("station_name"),
        _text(df, ["latitud"], None).alias("lat"),
        _text(df, ["longitud"], None).alias("lon"),
        _text(df, ["provincia"], None).alias("provincia"),
        F.lit(source).alias("source"),
    )
