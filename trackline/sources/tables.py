"""Catalog reads: curated tables with fallbacks, user SQL, table inventory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from trackline import schemas
from trackline.operators.flatten import flatten_alerts, flatten_trip_updates, flatten_vehicles
from trackline.operators.normalize import (
    normalize_alerts,
    normalize_geo_points,
    normalize_routes,
    normalize_scheduled_trips,
    normalize_stops,
    normalize_trip_updates,
    normalize_vehicles,
    project_station_list,
)

NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "stations": normalize_geo_points,
    "avld": normalize_geo_points,
    "feve": normalize_geo_points,
    "cercanias_madrid": normalize_geo_points,
    "gtfs_stops": normalize_stops,
    "gtfs_routes": normalize_routes,
    "gtfs_trips": normalize_scheduled_trips,
    "trip_updates": normalize_trip_updates,
    "vehicles": normalize_vehicles,
    "alerts": normalize_alerts,
}

# Bronze table and source tag per station list.
STATION_TABLES = {
    "stations": ("bronze_csv_estaciones", "estaciones"),
    "avld": ("bronze_csv_listado_completo_av_ld_md", "av_ld"),
    "feve": ("bronze_csv_listado_de_estaciones_feve_2", "feve"),
    "cercanias_madrid": ("bronze_csv_listado_estaciones_cercanias_madrid", "cercanias_madrid"),
}
# Tables tried in order for the remaining datasets.
CURATED = {
    "stations": "stations_dim",
    "avld": "stations_avld",
    "feve": "stations_feve",
    "cercanias_madrid": "stations_cercanias_madrid",
    "gtfs_stops": "stops_dim",
    "trip_updates": "trip_updates_rt",
    "vehicles": "vehicle_positions_rt",
    "gtfs_routes": "routes_dim",
    "gtfs_trips": "trips_dim",
    "alerts": "alerts_rt",
    "incidents": "incidents",
    "atendo": "atendo_accessibility",
    "train_info": "train_info",
}
BRONZE = {
    "gtfs_stops": ["bronze_google_transit_stops"],
    "gtfs_routes": ["bronze_google_transit_routes", "bronze_fomento_transit_routes", "bronze_horarios_feve_routes"],
    "gtfs_trips": ["bronze_google_transit_trips", "bronze_fomento_transit_trips", "bronze_horarios_feve_trips"],
    "incidents": ["bronze_json_rfincidentreports_co_noticeresults"],
    "atendo": ["bronze_csv_listado_de_estaciones_con_servicio_de_atendo"],
    "train_info": ["bronze_csv_informacion_trenes"],
}
TRIP_FEEDS = [
    ("bronze_json_trip_updates", "Cercanias", "arrival"),
    ("bronze_json_trip_updates_ld", "LD", "plain"),
]
VEHICLE_TABLE = "bronze_json_vehicle_positions"
ALERT_TABLE = "bronze_json_alerts"


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {database}{at}")


def first_available(spark: SparkSession, candidates: Sequence[str], schema: StructType) -> DataFrame:
    """The first table that exists, or a typed empty frame."""
    found = next((t for t in candidates if spark.catalog.tableExists(t)), None)
    return spark.table(found) if found else schemas.empty(spark, schema)


def normalizer(key: str) -> Callable[[DataFrame], DataFrame]:
    """The normaliser of a dataset, row by row. Trip updates keep entity ids: the delay model tells rows apart by them."""
    if key == "trip_updates":
        return lambda df: normalize_trip_updates(df, keep_entity_id=True)
    return NORMALIZERS.get(key, lambda df: df)


def load_tables(spark: SparkSession, database: str, curated: bool = True) -> dict[str, DataFrame]:
    """The bundle from a database: curated tables where present, else bronze ones."""
    out = schemas.empty_bundle(spark)

    def exists(table: str) -> bool:
        return spark.catalog.tableExists(f"{database}.{table}")

    for key in out:
        if curated and key in CURATED and exists(CURATED[key]):
            frames = [spark.table(f"{database}.{CURATED[key]}")]
        else:
            frames = [read(spark.table(f"{database}.{name}")) for name, read in bronze_sources(key, exists)]
        out[key] = normalizer(key)(reduce(DataFrame.unionByName, frames) if frames else out[key])
    return out


def bronze_sources(key: str, exists: Callable[[str], bool]) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The bronze tables that feed a dataset, each with how its rows become the dataset's, row by row."""
    if key in STATION_TABLES:
        name, source = STATION_TABLES[key]
        found = [(name, lambda df: project_station_list(df, source))]
    elif key == "trip_updates":
        found = [(name, lambda df, f=feed, m=mode: flatten_trip_updates(df, f, m)) for name, feed, mode in TRIP_FEEDS]
    elif key == "vehicles":
        found = [(VEHICLE_TABLE, flatten_vehicles)]
    elif key == "alerts":
        found = [(ALERT_TABLE, flatten_alerts)]
    else:
        # The first that exists; the others only stand in for it.
        return [(name, lambda df: df) for name in BRONZE.get(key, []) if exists(name)][:1]
    return [(name, read) for name, read in found if exists(name)]


def load_queries(spark: SparkSession, queries: dict[str, str]) -> dict[str, DataFrame]:
    """The bundle from user SQL per dataset; datasets without SQL are empty."""
    out = schemas.empty_bundle(spark)
    for key, sql in queries.items():
        if sql and sql.strip():
            out[key] = NORMALIZERS.get(key, lambda df: df)(spark.sql(sql))
    return out


def with_layer_and_domain(tables: DataFrame) -> DataFrame:
    """Layer by name prefix, domain by the first word after it."""
    name = F.col("table_name")
    return tables.withColumns(
        {
            "layer": F.when(name.startswith("bronze_"), "Bronze").otherwise("Curated"),
            "domain": F.get(F.split(F.replace(name, F.lit("bronze_"), F.lit("")), "_"), F.lit(0)),
        }
    )


def table_inventory(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a database with type, storage format, layer and domain, by name."""
    listed = spark.sql(f"SHOW TABLE EXTENDED IN {database} LIKE '*'").filter(~F.col("isTemporary"))
    return with_layer_and_domain(
        listed.select(
            F.col("tableName").alias("table_name"),
            F.regexp_extract("information", r"(?m)^Type: (\S+)", 1).alias("table_type"),
            F.upper(F.regexp_extract("information", r"(?m)^Provider: (\S+)", 1)).alias("data_source_format"),
        )
    ).orderBy("table_name")
