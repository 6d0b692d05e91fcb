"""The dataset bundle from a folder of raw files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackline import schemas
from trackline.operators.flatten import flatten_alerts, flatten_trip_updates, flatten_vehicles
from trackline.operators.normalize import normalize_station_csv, normalize_stops
from trackline.operators.stations import concat_station_lists
from trackline.sources.readers import (
    broken_files,
    path_exists,
    read_array_document,
    read_csv_flexible,
    read_document,
    read_if_exists,
    read_schedule,
)

# File names and the source tag of each station list, in order.
STATION_FILES = [
    ("estaciones.csv", "General"),
    ("listado_completo_av_ld_md.csv", "AV/LD"),
    ("listado-estaciones-cercanias-madrid.csv", "Cercanias Madrid"),
    ("listado-de-estaciones-feve-2.csv", "FEVE"),
]
ACCESS_FILE = "listado-de-estaciones-con-servicio-de-atendo.csv"
TRIP_FEEDS = [("Cercanias", "trip_updates.json"), ("LD", "trip_updates_LD.json")]
VEHICLE_FILE = "vehicle_positions.json"
ALERT_FILE = "alerts.json"
INCIDENT_FILE = "rfincidentreports_co.noticeresults.json"
SCHEDULE_FOLDER = "google_transit"


# Every file of a bundle: dataset, place in the folder and kind.
SOURCES = [
    *[("stations", name, "csv") for name, _ in STATION_FILES],
    ("atendo", ACCESS_FILE, "csv"),
    *[(f"gtfs_{name}", f"{SCHEDULE_FOLDER}/{name}.txt", "csv") for name in ("stops", "routes", "trips")],
    *[("trip_updates", name, "json") for _, name in TRIP_FEEDS],
    ("vehicles", VEHICLE_FILE, "json"),
    ("alerts", ALERT_FILE, "json"),
    ("incidents", INCIDENT_FILE, "json"),
]


def rejected_files(spark: SparkSession, base: str) -> DataFrame:
    """(dataset, source, file, reason) for what ``load_files`` leaves out: sources that are missing, files that are broken."""
    root, missing, frames = base.rstrip("/"), [], []
    for dataset, name, kind in SOURCES:
        if path_exists(spark, f"{root}/{name}"):
            found = broken_files(spark, f"{root}/{name}", kind)
            frames.append(found.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("source"), "file", "reason"))
        else:
            missing.append((dataset, name, None, "missing"))
    frames.append(spark.createDataFrame(missing, "dataset string, source string, file string, reason string"))
    return reduce(DataFrame.unionByName, frames)


def load_files(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Read every dataset of a folder; without a file that can be read it is a typed empty dataset.

    Broken files are left out, other files of the same source are not; ``rejected_files`` names them.
    """
    root = base.rstrip("/")
    out = schemas.empty_bundle(spark)

    lists = [
        normalize_station_csv(read_csv_flexible(spark, f"{root}/{name}"), source)
        for name, source in STATION_FILES
        if path_exists(spark, f"{root}/{name}")
    ]
    if lists:
        out["stations"] = concat_station_lists(lists)
    if path_exists(spark, f"{root}/{ACCESS_FILE}"):
        access = read_csv_flexible(spark, f"{root}/{ACCESS_FILE}")
        out["atendo"] = access if access.columns else out["atendo"]

    for key, name in (("gtfs_stops", "stops"), ("gtfs_routes", "routes"), ("gtfs_trips", "trips")):
        path = f"{root}/{SCHEDULE_FOLDER}/{name}.txt"
        table = read_if_exists(spark, path, lambda p: read_schedule(spark, p), schemas.BUNDLE[key])
        out[key] = table if out[key].columns[0] in table.columns or broken_files(spark, path, "csv").isEmpty() else out[key]
    out["gtfs_stops"] = normalize_stops(out["gtfs_stops"])

    for feed, name in TRIP_FEEDS:
        if path_exists(spark, f"{root}/{name}"):
            document = read_document(spark, f"{root}/{name}", schemas.TRIP_FEED)
            rows = flatten_trip_updates(document, feed, mode="departure", keep_empty=False)
            out["trip_updates"] = out["trip_updates"].unionByName(rows)
    if path_exists(spark, f"{root}/{VEHICLE_FILE}"):
        document = read_document(spark, f"{root}/{VEHICLE_FILE}", schemas.VEHICLE_FEED)
        out["vehicles"] = flatten_vehicles(document, keep_empty=False, drop_null_coords=True)
    if path_exists(spark, f"{root}/{ALERT_FILE}"):
        document = read_document(spark, f"{root}/{ALERT_FILE}", schemas.ALERT_FEED)
        out["alerts"] = flatten_alerts(document, keep_empty=False, missing_text="")
    if path_exists(spark, f"{root}/{INCIDENT_FILE}"):
        out["incidents"] = read_array_document(spark, f"{root}/{INCIDENT_FILE}", schemas.INCIDENTS)
    return out
