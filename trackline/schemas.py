"""Declared schemas: canonical datasets and the nested live feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TEXT, _DOUBLE, _INT, _LONG, _TIME = StringType(), DoubleType(), IntegerType(), LongType(), TimestampType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def _texts(*names: str) -> StructType:
    return _struct(**{name: _TEXT for name in names})


STATIONS = _struct(
    station_code=_TEXT, station_name=_TEXT, lat=_DOUBLE, lon=_DOUBLE, province=_TEXT, source=_TEXT
)
TRIP_UPDATES = _struct(feed=_TEXT, entity_id=_TEXT, trip_id=_TEXT, delay_seconds=_DOUBLE, timestamp=_TIME)
VEHICLES = _struct(
    entity_id=_TEXT,
    trip_id=_TEXT,
    vehicle_id=_TEXT,
    vehicle_label=_TEXT,
    status=_TEXT,
    stop_id=_TEXT,
    lat=_DOUBLE,
    lon=_DOUBLE,
)
ROUTES = _texts("route_id", "route_short_name", "route_type")
SCHEDULED_TRIPS = _struct(trip_id=_TEXT, route_id=_TEXT, direction_id=_INT)
STOPS = _struct(stop_id=_TEXT, stop_name=_TEXT, stop_lat=_DOUBLE, stop_lon=_DOUBLE)
ALERTS = _struct(id=_TEXT, route_count=_INT, description=_TEXT)
INCIDENTS = _texts("chipText", "aspect", "paragraph", "link")
ACCESSIBILITY = _texts("aparcamiento", "and_n", "aseos", "vest_bulo", "tiempo_de_antelacion")
TRAIN_INFO = _texts("modelo", "constructor", "velocidad_maxima", "plazas_sentadas", "proposito")
TABLE_INVENTORY = _texts("table_name", "table_type", "data_source_format", "layer", "domain")

# The dataset bundle: every key the analytics read, with its schema.
BUNDLE = {
    "stations": STATIONS,
    "avld": STATIONS,
    "feve": STATIONS,
    "cercanias_madrid": STATIONS,
    "gtfs_stops": STOPS,
    "gtfs_routes": ROUTES,
    "gtfs_trips": SCHEDULED_TRIPS,
    "trip_updates": TRIP_UPDATES,
    "vehicles": VEHICLES,
    "alerts": ALERTS,
    "incidents": INCIDENTS,
    "atendo": ACCESSIBILITY,
    "train_info": TRAIN_INFO,
}

# Nested documents. Declared because inference cannot see through empty arrays.
_HEADER = _texts("timestamp")
_STOP_EVENT = _struct(delay=_LONG)


def _feed(**payload: DataType) -> StructType:
    return _struct(header=_HEADER, entity=ArrayType(_struct(id=_TEXT, **payload)))


TRIP_FEED = _feed(
    tripUpdate=_struct(
        trip=_texts("tripId"),
        delay=_LONG,
        stopTimeUpdate=ArrayType(_struct(arrival=_STOP_EVENT, departure=_STOP_EVENT)),
    )
)
VEHICLE_FEED = _feed(
    vehicle=_struct(
        trip=_texts("tripId"),
        vehicle=_texts("id", "label"),
        currentStatus=_TEXT,
        stopId=_TEXT,
        position=_struct(latitude=_DOUBLE, longitude=_DOUBLE),
    )
)
ALERT_FEED = _feed(
    alert=_struct(
        informedEntity=ArrayType(_texts("routeId")),
        descriptionText=_struct(translation=ArrayType(_texts("text"))),
    )
)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def empty_bundle(spark: SparkSession) -> dict[str, DataFrame]:
    """Typed empty frame for every dataset key."""
    return {key: empty(spark, schema) for key, schema in BUNDLE.items()}
