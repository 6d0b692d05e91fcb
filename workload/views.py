"""The driver tables in the shape of transit data.

Each view is SQL that Spark and DuckDB both accept. The tables hold no missing or bad
values, so the views put them in. Every view covers its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # One live-feed document per event: an outward and a return update, or no entity at all.
    "fx_feed_rows": """
        SELECT event_id, event_type, value < 0.5 AS is_empty,
               CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'A' ELSE 'B' END AS service,
               date_trunc('hour', ts) AS feed_ts,
               CAST(event_id AS STRING) AS entity_id,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id * 2 AS STRING) END AS trip_id,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) - 600 END AS delay,
               CASE WHEN event_id % 8 = 0 THEN CAST(floor(value * 60) AS BIGINT) - 300 END AS arr_delay,
               CASE WHEN event_id % 16 = 4 THEN CAST(floor(value * 30) AS BIGINT) END AS dep_delay,
               CASE WHEN event_id % 16 = 12 THEN 0 WHEN event_id % 16 = 1 THEN NULL ELSE 1 END AS n_stops,
               concat(CAST(event_id AS STRING), '-r') AS back_entity_id,
               CAST(event_id * 2 + 1 AS STRING) AS back_trip_id,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) - 100 END AS back_delay
        FROM events""",
    # Flat form of those documents before any delay rule.
    "fx_feed_flat": """
        SELECT service, feed_ts, entity_id, trip_id, delay,
               CASE WHEN n_stops = 1 THEN arr_delay END AS arr_delay,
               CASE WHEN n_stops = 1 THEN dep_delay END AS dep_delay
        FROM fx_feed_rows WHERE NOT is_empty
        UNION ALL
        SELECT service, feed_ts, back_entity_id, back_trip_id, back_delay, NULL, NULL
        FROM fx_feed_rows WHERE NOT is_empty
        UNION ALL
        SELECT service, feed_ts, NULL, NULL, NULL, NULL, NULL FROM fx_feed_rows WHERE is_empty""",
    "fx_updates": """
        SELECT event_type AS feed, entity_id, trip_id,
               CAST(COALESCE(delay, arr_delay, dep_delay) AS DOUBLE) AS delay_seconds,
               CASE WHEN event_id % 31 = 0 THEN NULL ELSE feed_ts END AS timestamp
        FROM fx_feed_rows""",
    # Loosely named, all text, delay in minutes.
    "fx_raw_updates": """
        SELECT CAST(event_id AS STRING) AS tripId, event_type AS service,
               CASE event_id % 13 WHEN 0 THEN 'n/d' WHEN 1 THEN '' WHEN 2 THEN '1.5d' WHEN 3 THEN 'inf' WHEN 4 THEN NULL
                    WHEN 5 THEN concat(' ', CAST(event_id % 90 AS STRING), '.5 ')
                    ELSE CAST(event_id % 200 - 20 AS STRING) END AS delay_min,
               CASE WHEN event_id % 29 = 0 THEN 'soon' ELSE CAST(date_trunc('second', ts) AS STRING) END AS event_time
        FROM events""",
    # Four station lists: text numbers with decimal commas or points, blanks, bad coordinates, and a padded copy of every station.
    "fx_stations_raw": """
        SELECT c_custkey % 4 AS list_no, CAST(c_custkey AS STRING) AS station_code, c_name AS station_name,
               CASE WHEN c_custkey % 97 = 5 THEN NULL WHEN c_custkey % 89 = 7 THEN '0,0' WHEN c_custkey % 83 = 3 THEN 'n/d'
                    ELSE concat(CAST(20 + c_custkey % 30 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE ',' END,
                                CAST(c_custkey % 10 AS STRING)) END AS lat_raw,
               concat(CAST((c_custkey * 7) % 40 - 25 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE ',' END,
                      CAST(c_custkey % 10 AS STRING)) AS lon_raw,
               CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 70 = 1 THEN NULL ELSE n_name END AS province,
               concat('list_', CAST(c_custkey % 4 AS STRING)) AS source
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT c_custkey % 4, concat(' ', CAST(c_custkey AS STRING), ' '), c_name,
               concat(CAST(20 + c_custkey % 30 AS STRING), ',', CAST(c_custkey % 10 AS STRING)),
               concat(CAST((c_custkey * 7) % 40 - 25 AS STRING), ',', CAST(c_custkey % 10 AS STRING)),
               'ZZ_DUP', concat('list_', CAST(c_custkey % 4 AS STRING))
        FROM customer""",
    "fx_stations": """
        SELECT list_no, station_code, station_name,
               CASE WHEN lat_raw <> 'n/d' THEN CAST(replace(lat_raw, ',', '.') AS DOUBLE) END AS lat,
               CAST(replace(lon_raw, ',', '.') AS DOUBLE) AS lon, province, source
        FROM (SELECT list_no, station_code, station_name, lon_raw, province, source,
                     CASE WHEN lat_raw = 'n/d' THEN NULL ELSE lat_raw END AS lat_raw FROM fx_stations_raw) s""",
    "fx_vehicles": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS entity_id,
               CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS trip_id,
               CAST(l_suppkey AS STRING) AS vehicle_id,
               concat('V', CAST(l_suppkey AS STRING)) AS vehicle_label,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'IN_TRANSIT_TO'
                    WHEN l_returnflag = 'N' THEN 'STOPPED_AT' ELSE 'INCOMING_AT' END AS status,
               CAST(l_partkey AS STRING) AS stop_id,
               CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 36 + (l_partkey % 80) / CAST(10 AS DOUBLE) END AS lat,
               (l_partkey % 120) / CAST(10 AS DOUBLE) - 9 AS lon
        FROM lineitem""",
    # Scheduled trips; urgent orders are listed twice, so their keys repeat.
    "fx_trips": """
        SELECT CAST(o_orderkey AS STRING) AS trip_id, concat('R', CAST(o_custkey AS STRING)) AS route_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS STRING) END AS direction_id
        FROM orders
        UNION ALL
        SELECT CAST(o_orderkey AS STRING), concat('R', CAST(o_custkey AS STRING)), '1'
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    # Routes; every fifth id matches no trip.
    "fx_routes": """
        SELECT concat(CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE 'R' END, CAST(c_custkey AS STRING)) AS route_id,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('C', CAST(c_custkey % 17 AS STRING)) END AS route_short_name,
               CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '109' END AS route_type
        FROM customer""",
    # Alerts; every 15th names no route and has no text.
    "fx_alerts": """
        SELECT CAST(conv_id AS STRING) AS id,
               CAST(CASE WHEN conv_id % 15 = 0 THEN 0 ELSE count(*) END AS INT) AS route_count,
               CASE WHEN conv_id % 15 = 0 THEN NULL ELSE min(CASE WHEN turn = 0 THEN text END) END AS description
        FROM conversations GROUP BY conv_id""",
    "fx_incidents": """
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'AVISO' ELSE 'OBRAS' END AS chipText,
               CASE WHEN page_id % 2 = 0 THEN 'red' ELSE 'amber' END AS aspect, html AS paragraph, url AS link
        FROM pages""",
    "fx_access": """
        SELECT p_partkey,
               CASE p_size % 4 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' WHEN 2 THEN 'SIN' ELSE NULL END AS aparcamiento,
               CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS and_n,
               CASE WHEN p_partkey % 5 = 0 THEN 'Yes' ELSE 'no' END AS aseos,
               CASE WHEN p_partkey % 7 = 0 THEN '1' ELSE '0' END AS vest_bulo,
               CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat(CAST(p_size % 3 * 15 AS STRING), ' min') END
                 AS tiempo_de_antelacion
        FROM part""",
    "fx_train_info": """
        SELECT p_name AS modelo, CASE WHEN p_partkey % 40 = 0 THEN '' ELSE p_brand END AS constructor,
               CASE WHEN p_partkey % 11 = 0 THEN 'n/d' ELSE concat('max ', CAST(p_size * 5 AS STRING), ',5 km/h') END
                 AS velocidad_maxima,
               CAST(p_size * 10 AS STRING) AS plazas_sentadas,
               CASE WHEN p_partkey % 25 = 0 THEN '' ELSE p_type END AS proposito, p_partkey
        FROM part""",
    # File names of a raw folder, one per document.
    "fx_files": """
        SELECT concat(CASE doc_id % 7 WHEN 0 THEN 'google_transit/' WHEN 1 THEN 'horarios-feve/'
                      WHEN 2 THEN 'other/' ELSE '' END,
                      CASE WHEN doc_id % 5 = 0 THEN '2024 ' ELSE '' END, 'Lista ', source, '-', CAST(doc_id AS STRING),
                      CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' WHEN 3 THEN '.pb'
                      WHEN 4 THEN '.xlsx' ELSE '.md' END) AS rel_path
        FROM documents""",
    # Catalog entries, one per part.
    "fx_tables": """
        SELECT concat(CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'bronze_csv_' WHEN 2 THEN 'bronze_json_'
                      WHEN 3 THEN 'a_bronze_' ELSE 'bronze_google_transit_' END,
                      lower(replace(p_name, ' ', '_')), '_', CAST(p_partkey AS STRING)) AS table_name,
               'EXTERNAL' AS table_type, 'PARQUET' AS data_source_format
        FROM part""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """``sql`` with the views it uses put in front as common table expressions."""
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in _needs(text):
            if name not in ordered:
                add(VIEWS[name])
                ordered.append(name)

    add(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    return f"WITH {ctes}\n{sql}"


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view as a DataFrame over the parquet tables of ``sf_dir``."""
    sql = with_views(f"SELECT * FROM {view}")
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def trip_feed(spark: SparkSession, sf_dir: str, service: str) -> DataFrame:
    """Nested trip-update documents of one service."""
    rows = frame(spark, sf_dir, "fx_feed_rows").filter(F.col("service") == service)
    stop = F.struct(
        F.struct(F.col("arr_delay").alias("delay")).alias("arrival"),
        F.struct(F.col("dep_delay").alias("delay")).alias("departure"),
    )
    no_stops = F.filter(F.array(stop), lambda s: F.lit(False))
    # Null, empty, one stop or two, of which the first counts.
    later = F.struct(F.struct((F.col("event_id") + 7).alias("delay")).alias("arrival"), stop["departure"].alias("departure"))
    some = F.when(F.col("event_id") % 3 == 0, F.array(stop, later)).otherwise(F.array(stop))
    stops = F.when(F.col("n_stops") == 1, some).when(F.col("n_stops") == 0, no_stops)

    def entity(entity_id: str, trip_id: str, delay: str, stop_list) -> F.Column:
        update = F.struct(
            F.struct(F.col(trip_id).alias("tripId")).alias("trip"),
            F.col(delay).alias("delay"),
            stop_list.alias("stopTimeUpdate"),
        )
        return F.struct(F.col(entity_id).alias("id"), update.alias("tripUpdate"))

    both = F.array(
        entity("entity_id", "trip_id", "delay", stops), entity("back_entity_id", "back_trip_id", "back_delay", no_stops)
    )
    return rows.select(
        F.struct(F.unix_seconds(F.col("feed_ts").cast("timestamp")).cast("string").alias("timestamp")).alias("header"),
        F.filter(both, lambda e: ~F.col("is_empty")).alias("entity"),
    )


def vehicle_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested vehicle documents, one position each."""
    entity = F.struct(
        F.col("entity_id").alias("id"),
        F.struct(
            F.struct(F.col("trip_id").alias("tripId")).alias("trip"),
            F.struct(F.col("vehicle_id").alias("id"), F.col("vehicle_label").alias("label")).alias("vehicle"),
            F.col("status").alias("currentStatus"),
            F.col("stop_id").alias("stopId"),
            F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position"),
        ).alias("vehicle"),
    )
    return frame(spark, sf_dir, "fx_vehicles").select(F.array(entity).alias("entity"))


def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested alert documents, one alert each; informed entities are the turns, and so are the translations."""
    turns = frame(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    )
    alerts = frame(spark, sf_dir, "fx_alerts").join(turns, "id")
    route = F.struct(F.lit("R").alias("routeId"))
    informed = F.when(F.col("route_count") > 0, F.array_repeat(route, F.col("route_count")))
    every = F.transform("turns", lambda t: F.struct(t.text.alias("text")))
    texts = F.when(F.col("description").isNotNull(), every)
    entity = F.struct(
        F.col("id"),
        F.struct(
            informed.alias("informedEntity"), F.struct(texts.alias("translation")).alias("descriptionText")
        ).alias("alert"),
    )
    return alerts.select(F.array(entity).alias("entity"))


def station_lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four lists under their bundle names."""
    stations = frame(spark, sf_dir, "fx_stations")
    names = ("stations", "avld", "feve", "cercanias_madrid")
    return {name: stations.filter(F.col("list_no") == i).drop("list_no") for i, name in enumerate(names)}


SOURCES = {
    "trip_updates": ("fx_updates", None),
    "vehicles": ("fx_vehicles", None),
    "gtfs_routes": ("fx_routes", None),
    "gtfs_trips": ("fx_trips", None),
    "alerts": ("fx_alerts", None),
    "incidents": ("fx_incidents", "page_id"),
    "atendo": ("fx_access", "p_partkey"),
    "train_info": ("fx_train_info", "p_partkey"),
}


def bundle(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The station lists and the named datasets, or every dataset the reports need."""
    out = station_lists(spark, sf_dir)
    for name in names or SOURCES:
        view, extra = SOURCES[name]
        df = frame(spark, sf_dir, view)
        out[name] = df.drop(extra) if extra else df
    return out
