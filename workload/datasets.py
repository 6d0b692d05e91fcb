"""Queries: flattening, normalising, conforming, filtering, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.functions import speed_value
from trackline.operators import filters, normalize
from trackline.operators.columns import preview
from trackline.operators.flatten import flatten_alerts, flatten_trip_updates, flatten_vehicles, trip_updates_of_feeds
from trackline.operators.stations import concat_station_lists, station_master
from trackline.sources.inventory import route_files, spec_table, uncovered_files
from trackline.sources.tables import with_layer_and_domain
from workload import views
from workload.registry import ntz, query, sql_number

MASTER = """
    SELECT station_code, station_name, lat, lon, province, source FROM (
      SELECT trim(station_code) AS station_code, trim(station_name) AS station_name, lat, lon, province, source,
             row_number() OVER (PARTITION BY trim(station_code), trim(station_name), lat, lon, source
                                ORDER BY list_no, province NULLS LAST) AS copy_no
      FROM fx_stations WHERE lat IS NOT NULL AND lon IS NOT NULL) s
    WHERE copy_no = 1"""


@query(
    "flatten_trip_updates",
    """SELECT CASE service WHEN 'A' THEN 'Cercanias' ELSE 'LD' END AS feed, entity_id, trip_id,
              CAST(CASE service WHEN 'A' THEN COALESCE(delay, arr_delay, 0) ELSE COALESCE(delay, 0) END AS DOUBLE)
                AS delay_seconds,
              feed_ts AS timestamp
       FROM fx_feed_flat""",
)
def flatten_both_feeds(spark, sf_dir):
    updates = trip_updates_of_feeds(views.trip_feed(spark, sf_dir, "A"), views.trip_feed(spark, sf_dir, "B"))
    return ntz(updates, "timestamp")


@query(
    "flatten_trip_updates_departure",
    """SELECT CASE service WHEN 'A' THEN 'Cercanias' ELSE 'LD' END AS feed, entity_id, trip_id,
              CAST(COALESCE(delay, arr_delay, dep_delay) AS DOUBLE) AS delay_seconds, feed_ts AS timestamp
       FROM fx_feed_flat WHERE entity_id IS NOT NULL""",
)
def flatten_departure(spark, sf_dir):
    near, far = (
        flatten_trip_updates(views.trip_feed(spark, sf_dir, service), feed, "departure", keep_empty=False)
        for service, feed in (("A", "Cercanias"), ("B", "LD"))
    )
    return ntz(near.unionByName(far), "timestamp")


@query(
    "flatten_vehicles",
    "SELECT entity_id, trip_id, vehicle_id, vehicle_label, status, stop_id, lat, lon FROM fx_vehicles",
)
def flatten_vehicle_feed(spark, sf_dir):
    return flatten_vehicles(views.vehicle_feed(spark, sf_dir))


@query(
    "flatten_vehicles_located",
    """SELECT entity_id, trip_id, vehicle_id, vehicle_label, status, stop_id, lat, lon
       FROM fx_vehicles WHERE lat IS NOT NULL""",
)
def flatten_located_vehicles(spark, sf_dir):
    return flatten_vehicles(views.vehicle_feed(spark, sf_dir), keep_empty=False, drop_null_coords=True)


@query("flatten_alerts", "SELECT id, route_count, description FROM fx_alerts")
def flatten_alert_feed(spark, sf_dir):
    return flatten_alerts(views.alert_feed(spark, sf_dir))


@query(
    "norm_trip_updates",
    f"""SELECT service AS feed, CAST(NULL AS VARCHAR) AS entity_id, tripId AS trip_id, delay * 60.0 AS delay_seconds,
               TRY_CAST(event_time AS TIMESTAMP) AS timestamp
        FROM (SELECT service, tripId, event_time, {sql_number("delay_min")} AS delay FROM fx_raw_updates) r
        WHERE delay IS NOT NULL""",
)
def norm_trip_updates(spark, sf_dir):
    return ntz(normalize.normalize_trip_updates(views.frame(spark, sf_dir, "fx_raw_updates")), "timestamp")


@query(
    "norm_geo_points",
    f"""SELECT * FROM (
          SELECT station_code, station_name, {sql_number("replace(lat_raw, ',', '.')")} AS lat,
                 {sql_number("replace(lon_raw, ',', '.')")} AS lon, province, 'Warehouse SQL' AS source
          FROM fx_stations_raw) s WHERE lat IS NOT NULL AND lon IS NOT NULL""",
)
def norm_geo_points(spark, sf_dir):
    raw = views.frame(spark, sf_dir, "fx_stations_raw")
    loose = raw.select(
        F.col("station_code").alias("Codigo"),
        F.col("station_name").alias("Descripcion"),
        F.replace("lat_raw", F.lit(","), F.lit(".")).alias("Latitud"),
        F.replace("lon_raw", F.lit(","), F.lit(".")).alias("Longitud"),
        F.col("province").alias("Provincia"),
    )
    return normalize.normalize_geo_points(loose)


@query(
    "norm_vehicles",
    """SELECT entity_id, trip_id, vehicle_id, vehicle_label, status, '' AS stop_id, lat, lon
       FROM fx_vehicles WHERE lat IS NOT NULL AND lon IS NOT NULL""",
)
def norm_vehicles(spark, sf_dir):
    loose = views.frame(spark, sf_dir, "fx_vehicles").drop("stop_id").withColumnsRenamed(
        {"entity_id": "id", "vehicle_label": "Label", "status": "current_status", "lat": "latitude", "lon": "lng"}
    )
    return normalize.normalize_vehicles(loose)


@query("norm_routes", "SELECT route_id, route_short_name, 'Unknown' AS route_type FROM fx_routes")
def norm_routes(spark, sf_dir):
    routes = views.frame(spark, sf_dir, "fx_routes")
    return normalize.normalize_routes(routes.select("route_id", F.col("route_short_name").alias("line")))


@query(
    "norm_trips",
    "SELECT trip_id, route_id, CAST(COALESCE(TRY_CAST(direction_id AS INTEGER), 0) AS INTEGER) AS direction_id FROM fx_trips",
)
def norm_trips(spark, sf_dir):
    loose = views.frame(spark, sf_dir, "fx_trips").withColumnRenamed("trip_id", "service_key")
    return normalize.normalize_scheduled_trips(loose)


@query("norm_alerts", "SELECT id, route_count, description FROM fx_alerts")
def norm_alerts(spark, sf_dir):
    loose = views.frame(spark, sf_dir, "fx_alerts").select(
        F.col("id").alias("alert_id"),
        F.col("route_count").cast("string").alias("affected_routes"),
        F.col("description").alias("message"),
    )
    return normalize.normalize_alerts(loose)


@query(
    "norm_station_csv",
    f"""SELECT * FROM (
          SELECT trim(station_code) AS station_code, trim(station_name) AS station_name,
                 {sql_number("replace(lat_raw, ',', '.')")} AS lat, {sql_number("replace(lon_raw, ',', '.')")} AS lon,
                 trim(province) AS province, 'General' AS source
          FROM fx_stations_raw) s WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0""",
)
def norm_station_csv(spark, sf_dir):
    raw = views.frame(spark, sf_dir, "fx_stations_raw")
    spanish = raw.toDF("list_no", "Código", "Descripcion", "LATITUD", "Longitud", "Provincia", "origin")
    return normalize.normalize_station_csv(spanish, "General")


@query(
    "norm_stops",
    f"""SELECT station_code AS stop_id, station_name AS stop_name, {sql_number("lat_raw")} AS stop_lat,
               {sql_number("lon_raw")} AS stop_lon FROM fx_stations_raw""",
)
def norm_stops(spark, sf_dir):
    raw = views.frame(spark, sf_dir, "fx_stations_raw")
    return normalize.normalize_stops(
        raw.select(
            F.col("station_code").alias("stop_id"),
            F.col("station_name").alias("stop_name"),
            F.col("lat_raw").alias("stop_lat"),
            F.col("lon_raw").alias("stop_lon"),
        )
    )


@query(
    "project_station_list",
    """SELECT station_code, station_name, lat_raw AS lat, lon_raw AS lon, province AS provincia, 'av_ld' AS source
       FROM fx_stations_raw""",
)
def project_station_list(spark, sf_dir):
    raw = views.frame(spark, sf_dir, "fx_stations_raw")
    return normalize.project_station_list(
        raw.toDF("list_no", "c_digo", "descripcion", "latitud", "longitud", "provincia", "origin"), "av_ld"
    )


@query("station_master", MASTER)
def master(spark, sf_dir):
    return station_master(views.station_lists(spark, sf_dir))


@query(
    "station_list_concat",
    """SELECT station_code, station_name, lat, lon, province, source FROM (
         SELECT *, row_number() OVER (PARTITION BY trim(station_code), lat, lon, source
                                      ORDER BY list_no, station_name NULLS LAST, province NULLS LAST) AS copy_no
         FROM (SELECT list_no, trim(station_code) AS station_code, station_name, lat, lon, province, source
               FROM fx_stations) t WHERE lat IS NOT NULL) s
       WHERE copy_no = 1""",
)
def list_concat(spark, sf_dir):
    lists = views.station_lists(spark, sf_dir).values()
    return concat_station_lists(
        [df.dropna(subset=["lat"]).withColumn("station_code", F.trim("station_code")) for df in lists]
    )


@query(
    "business_filters_stations",
    """SELECT station_code, lat, lon, province, source FROM fx_stations
       WHERE province IN ('FRANCE', 'GERMANY', 'ZZ_DUP') AND source IN ('list_0', 'list_2', 'list_3')""",
)
def filtered_stations(spark, sf_dir):
    kept = filters.business_filters(
        views.station_lists(spark, sf_dir),
        provinces=["FRANCE", "GERMANY", "ZZ_DUP"],
        station_sources=["list_0", "list_2", "list_3"],
    )
    columns = ["station_code", "lat", "lon", "province", "source"]
    out = None
    for df in kept.values():
        out = df.select(*columns) if out is None else out.unionByName(df.select(*columns))
    return out


@query(
    "business_filters_updates",
    """SELECT feed, trip_id, delay_seconds, timestamp FROM fx_updates
       WHERE feed IN ('click', 'error') AND delay_seconds / 60.0 BETWEEN 0 AND 180""",
)
def filtered_updates(spark, sf_dir):
    kept = filters.business_filters({"trip_updates": views.frame(spark, sf_dir, "fx_updates")}, feeds=["click", "error"])
    return ntz(kept["trip_updates"].drop("entity_id"), "timestamp")


@query(
    "business_filters_fleet",
    """SELECT 'route' AS kind, route_id AS key FROM fx_routes WHERE route_type IN ('109')
       UNION ALL SELECT 'vehicle', entity_id FROM fx_vehicles WHERE status IN ('STOPPED_AT', 'INCOMING_AT')
       UNION ALL SELECT 'train', modelo FROM fx_train_info WHERE constructor IN ('Brand#1', 'Brand#7')""",
)
def filtered_fleet(spark, sf_dir):
    names = {"gtfs_routes": ("route", "route_id"), "vehicles": ("vehicle", "entity_id"), "train_info": ("train", "modelo")}
    data = views.bundle(spark, sf_dir, *names)
    kept = filters.business_filters(
        {n: data[n] for n in names},
        route_types=["109"],
        vehicle_statuses=["STOPPED_AT", "INCOMING_AT"],
        constructors=["Brand#1", "Brand#7"],
    )
    out = None
    for name, (kind, key) in names.items():
        rows = kept[name].select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "bbox_filter",
    f"SELECT * FROM ({MASTER}) m WHERE lat BETWEEN 27.0 AND 44.5 AND lon BETWEEN -19.5 AND 5.5",
)
def bbox_filter(spark, sf_dir):
    return filters.in_map_window(station_master(views.station_lists(spark, sf_dir)))


@query("layer_filter", f"SELECT * FROM ({MASTER}) m WHERE source IN ('list_1', 'list_3')")
def layer_filter(spark, sf_dir):
    return filters.map_layer(station_master(views.station_lists(spark, sf_dir)), ["list_1", "list_3"])


@query(
    "incident_preview",
    "SELECT chipText, aspect, paragraph, link FROM fx_incidents ORDER BY link, paragraph LIMIT 20",
)
def incident_preview(spark, sf_dir):
    table = views.frame(spark, sf_dir, "fx_incidents").withColumnRenamed("chipText", "chiptext")
    rows = preview(table, ["chipText", "aspect", "paragraph", "link"], 20, ["link", "paragraph"])
    return rows.withColumnRenamed("chiptext", "chipText")


@query(
    "fleet_preview",
    """SELECT modelo, constructor, velocidad_maxima, plazas_sentadas, proposito FROM fx_train_info
       ORDER BY modelo, constructor, velocidad_maxima, plazas_sentadas, proposito LIMIT 100""",
)
def fleet_preview(spark, sf_dir):
    columns = ["modelo", "constructor", "velocidad_maxima", "plazas_sentadas", "proposito"]
    return preview(views.frame(spark, sf_dir, "fx_train_info"), columns, 100, columns)


@query("alert_list", "SELECT id, route_count, description FROM fx_alerts ORDER BY id")
def alert_list(spark, sf_dir):
    return preview(views.frame(spark, sf_dir, "fx_alerts"), ["id", "route_count", "description"], None, ["id"])


@query(
    "accessibility_preview",
    """SELECT p_partkey, aparcamiento, and_n, aseos, vest_bulo, tiempo_de_antelacion
       FROM fx_access ORDER BY p_partkey LIMIT 50""",
)
def accessibility_preview(spark, sf_dir):
    return preview(views.frame(spark, sf_dir, "fx_access"), [], 50, ["p_partkey"])


@query(
    "train_speeds",
    """SELECT p_partkey, TRY_CAST(replace(NULLIF(regexp_extract(velocidad_maxima, '(\\d+[\\.,]?\\d*)', 1), ''), ',', '.')
              AS DOUBLE) AS speed FROM fx_train_info""",
)
def train_speeds(spark, sf_dir):
    trains = views.frame(spark, sf_dir, "fx_train_info")
    return trains.select("p_partkey", speed_value(F.col("velocidad_maxima")).alias("speed"))


# File routing in SQL: folder, stem and extension of each path, then the table rules.
_CLEAN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


def _sql_sanitized(column: str) -> str:
    clean = _CLEAN.format(column)
    return f"CASE WHEN {clean} = '' THEN 'dataset' WHEN regexp_matches({clean}, '^[0-9]') THEN concat('t_', {clean}) ELSE {clean} END"


ROUTED = f"""
    SELECT rel_path,
           CASE WHEN ext = 'json' THEN concat('bronze_json_', stem)
                WHEN ext = 'csv' THEN concat('bronze_csv_', stem)
                WHEN ext = 'txt' AND parent IN ('google_transit', 'fomento_transit', 'horarios-feve')
                  THEN concat('bronze_', {_sql_sanitized("parent")}, '_', stem)
                WHEN ext IN ('pb', 'xlsx') THEN concat('bronze_binary_', stem) END AS table_name,
           CASE WHEN ext = 'json' THEN 'json' WHEN ext IN ('pb', 'xlsx') THEN 'binaryFile' WHEN ext = 'csv' THEN 'csv'
                WHEN ext = 'txt' AND parent IN ('google_transit', 'fomento_transit', 'horarios-feve') THEN 'csv' END
             AS source_format
    FROM (SELECT rel_path, parent, ext, {_sql_sanitized("raw_stem")} AS stem FROM (
            SELECT rel_path, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS parent,
                   regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS raw_stem,
                   lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) AS ext FROM fx_files) a) b"""


@query("file_inventory_routing", ROUTED)
def file_inventory_routing(spark, sf_dir):
    return route_files(views.frame(spark, sf_dir, "fx_files")).select("rel_path", "table_name", "source_format")


@query("uncovered_files", f"SELECT rel_path FROM ({ROUTED}) r WHERE table_name IS NULL ORDER BY rel_path")
def uncovered(spark, sf_dir):
    files = views.frame(spark, sf_dir, "fx_files").withColumn("modified", F.current_timestamp())
    return uncovered_files(files, spec_table(files))


TABLES = """
    SELECT table_name, table_type, data_source_format,
           CASE WHEN table_name LIKE 'bronze\\_%' ESCAPE '\\' THEN 'Bronze' ELSE 'Curated' END AS layer,
           split_part(replace(table_name, 'bronze_', ''), '_', 1) AS domain
    FROM fx_tables"""


@query("table_inventory", f"{TABLES} ORDER BY table_name")
def table_inventory(spark, sf_dir):
    return with_layer_and_domain(views.frame(spark, sf_dir, "fx_tables")).orderBy("table_name")
