"""Queries: driver tables written as raw files, streamed into bronze tables, read back."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from trackline import schemas
from trackline.operators.counts import row_counts
from trackline.operators.flatten import trip_updates_of_feeds
from trackline.plans.curate import write_curated
from trackline.session import checkpointed, in_session, shared_dir, tidy
from trackline.sources.bundle import load_files, rejected_files
from trackline.sources.readers import read_array_document, read_csv_flexible, read_document
from trackline.sources.inventory import hidden_files, list_files, route_files
from trackline.sources.tables import load_queries, load_tables, table_inventory
from trackline.streaming.ingest import audit, coverage, ingest
from trackline.streaming.rescue import RESCUED, parse_documents
from workload import views
from workload.registry import ntz, query, sql_number

# Entities per written document.
DOCUMENT_ROWS = 500
# Runs whose folders and databases stay: the frame a query returns reads them after the query has returned.
KEPT_RUNS = 12
_RUNS: deque[Run] = deque()


class Run:
    """A fresh raw folder, state folder and database; the oldest of many is cleared away."""

    def __init__(self, spark: SparkSession):
        token = uuid.uuid4().hex
        self.spark = spark
        self.folder = shared_dir(spark, "trackline", token)
        self.raw = shared_dir(spark, "trackline", token, "raw")
        self.state = shared_dir(spark, "trackline", token, "state")
        self.location = shared_dir(spark, "trackline", token, "tables")
        self.database = f"bronze_{token}"
        _RUNS.append(self)
        while len(_RUNS) > KEPT_RUNS:
            _RUNS.popleft().clear()

    def clear(self) -> None:
        """Drop the run's databases and delete its folder, unless its session has ended."""
        if self.spark.sparkContext._jsc is None:
            return
        for database in (self.database, f"curated_{self.database}"):
            self.spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def load(self, **options):
        return ingest(self.spark, self.raw, self.state, self.database, self.location, **options)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "ISO-8859-1", mode: str = "errorifexists") -> None:
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, sep=sep, encoding=encoding, escape='"', emptyValue="", **blanks).csv(path)


def write_documents(rows: DataFrame, key: str, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """JSON array files of at most ``DOCUMENT_ROWS`` objects; ``key`` is a unique number."""
    group = F.floor(F.col(key) / DOCUMENT_ROWS)
    content = F.struct(*[c for c in rows.columns if c != key])
    texts = rows.groupBy(group.alias("part")).agg(F.to_json(F.collect_list(content)).alias("value"))
    texts = in_session(texts.select("value"), tidy(rows.sparkSession))
    texts.write.mode(mode).option("maxRecordsPerFile", 1).text(path, compression)


def write_single(texts: DataFrame, folder: str) -> None:
    """A file per text, and the empty ``_SUCCESS`` that a finished writer leaves.

    Python tasks write them: for each file Hadoop's local file system starts two processes that set its rights.
    """
    Path = texts.sparkSession._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    fs = Path(folder).getFileSystem(texts.sparkSession._jsc.hadoopConfiguration())
    fs.mkdirs(Path(folder))

    def write(rows: Iterable[Row]) -> None:
        from pyarrow import fs as stores

        store, place = stores.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        for at, row in enumerate(rows):
            with store.open_output_stream(f"{place}/part-{part:05d}-{at:09d}.txt") as out:
                out.write(f"{'' if row.value is None else row.value}\n".encode())

    texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "value").foreachPartition(write)
    fs.create(Path(f"{folder}/_SUCCESS")).close()


def numbered(rows: DataFrame) -> DataFrame:
    """Rows straight from the tables with a ``key`` that is dense within each part: documents are full, none holds more."""
    return rows.withColumn("key", F.monotonically_increasing_id())


def write_feeds(run: Run, sf_dir: str, compression: str = "none") -> None:
    """Both trip-update feeds as files."""
    for service, name in (("A", "trip_updates.json"), ("B", "trip_updates_LD.json")):
        write_documents(numbered(views.trip_feed(run.spark, sf_dir, service)), "key", f"{run.raw}/{name}", compression=compression)


def _stations(spark, sf_dir) -> DataFrame:
    raw = views.frame(spark, sf_dir, "fx_stations_raw")
    return raw.select(
        F.col("station_code").alias("CÓDIGO"),
        F.concat(F.lit("Estación "), "station_name").alias("DESCRIPCION"),
        F.col("lat_raw").alias("LATITUD"),
        F.col("lon_raw").alias("LONGITUD"),
        F.col("province").alias("PROVINCIA"),
    )


@query(
    "ingest_csv",
    """SELECT station_code AS c_digo, concat('Estación ', station_name) AS descripcion, lat_raw AS latitud, lon_raw AS longitud,
              NULLIF(province, '') AS provincia, CAST(NULL AS VARCHAR) AS rescued_data,
              'estaciones.csv' AS _source_pattern, 'csv' AS _source_format
       FROM fx_stations_raw""",
)
def ingest_csv(spark, sf_dir):
    run = Run(spark)
    write_csv(_stations(spark, sf_dir), f"{run.raw}/estaciones.csv")
    run.load()
    return run.table("bronze_csv_estaciones").drop("_ingest_ts", "_source_file_path")


@query(
    "ingest_gtfs",
    """SELECT trip_id, route_id, direction_id, CAST(NULL AS VARCHAR) AS rescued_data,
              'google_transit/trips.txt' AS _source_pattern FROM fx_trips""",
)
def ingest_gtfs(spark, sf_dir):
    run = Run(spark)
    write_csv(views.frame(spark, sf_dir, "fx_trips"), f"{run.raw}/google_transit/trips.txt", ",", "UTF-8")
    run.load()
    return run.table("bronze_google_transit_trips").drop("_ingest_ts", "_source_file_path", "_source_format")


@query(
    "ingest_json",
    """SELECT CASE service WHEN 'A' THEN 'Cercanias' ELSE 'LD' END AS feed, entity_id, trip_id,
              CAST(CASE service WHEN 'A' THEN COALESCE(delay, arr_delay, 0) ELSE COALESCE(delay, 0) END AS DOUBLE)
                AS delay_seconds, feed_ts AS timestamp
       FROM fx_feed_flat""",
)
def ingest_json(spark, sf_dir):
    """Both live feeds through files and bronze tables, then flattened."""
    run = Run(spark)
    write_feeds(run, sf_dir)
    run.load()
    updates = trip_updates_of_feeds(run.table("bronze_json_trip_updates"), run.table("bronze_json_trip_updates_ld"))
    return ntz(updates, "timestamp")


@query(
    "ingest_binary",
    """SELECT 'pages.pb' AS _source_pattern, 'binaryFile' AS _source_format,
              CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS stored_bytes,
              CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS listed_bytes FROM pages""",
)
def ingest_binary(spark, sf_dir):
    """Whole page texts as opaque files: the bytes stored and the sizes listed."""
    run = Run(spark)
    views.frame(spark, sf_dir, "fx_incidents").select("paragraph").write.text(f"{run.raw}/pages.pb")
    run.load()
    return run.table("bronze_binary_pages").groupBy("_source_pattern", "_source_format").agg(
        F.sum(F.octet_length("content").cast("bigint")).alias("stored_bytes"), F.sum("length").alias("listed_bytes")
    )


@query(
    "ingest_rescue",
    """SELECT trip_id, route_id, direction_id,
              CASE WHEN direction_id IS NULL THEN concat(trip_id, ';', route_id)
                   WHEN direction_id = '1' THEN concat(trip_id, ';', route_id, ';1;late') END AS rescued_data
       FROM (SELECT trip_id, route_id, direction_id FROM fx_trips) t""",
)
def ingest_rescue(spark, sf_dir):
    """Lines with a field too many or too few keep their text."""
    run = Run(spark)
    trips = views.frame(spark, sf_dir, "fx_trips")
    line = F.when(F.col("direction_id").isNull(), F.concat_ws(";", "trip_id", "route_id")).when(
        F.col("direction_id") == "1", F.concat(F.concat_ws(";", "trip_id", "route_id", "direction_id"), F.lit(";late"))
    ).otherwise(F.concat_ws(";", "trip_id", "route_id", "direction_id"))
    header = "trip_id;route_id;direction_id"
    # A quote character that never occurs keeps the separators of the line bare.
    trips.select(line.alias(header)).write.options(header=True, sep="\t", quote="", escapeQuotes=False).csv(
        f"{run.raw}/trips.csv"
    )
    run.load()
    return run.table("bronze_csv_trips").select("trip_id", "route_id", "direction_id", "rescued_data")


@query(
    "ingest_evolution",
    """SELECT id, route_count, CAST(NULL AS VARCHAR) AS description FROM fx_alerts
       UNION ALL SELECT id, CAST(route_count AS BIGINT), description FROM fx_alerts""",
)
def ingest_evolution(spark, sf_dir):
    """A second delivery brings a new field; the rows of the first read it as null."""
    run = Run(spark)
    alerts = views.frame(spark, sf_dir, "fx_alerts").withColumn("key", F.col("id").cast("bigint"))
    path = f"{run.raw}/notices.json"
    write_documents(alerts.select("key", "id", "route_count"), "key", path)
    run.load()
    write_documents(alerts, "key", path, mode="append")
    run.load()
    return run.table("bronze_json_notices").select("id", "route_count", "description")


@query(
    "ingest_audit",
    """SELECT 'bronze_csv_estaciones' AS table_name, 'estaciones.csv' AS _source_pattern, count(*) AS rows FROM fx_stations_raw
       UNION ALL SELECT 'bronze_google_transit_trips', 'google_transit/trips.txt', 2 * count(*) FROM fx_trips""",
)
def ingest_audit(spark, sf_dir):
    """Row counts after a first load, a rerun without news and a rerun with one new delivery."""
    run = Run(spark)
    trips = views.frame(spark, sf_dir, "fx_trips")
    write_csv(_stations(spark, sf_dir), f"{run.raw}/estaciones.csv")
    write_csv(trips, f"{run.raw}/google_transit/trips.txt", ",", "UTF-8")
    run.load()
    run.load()
    write_csv(trips, f"{run.raw}/google_transit/trips.txt", ",", "UTF-8", mode="append")
    return audit(spark, run.database, run.load())


@query(
    "ingest_encoding",
    """SELECT station_code AS "CÓDIGO", concat('Estación ', station_name) AS "DESCRIPCION", lat_raw AS "LATITUD",
              lon_raw AS "LONGITUD", NULLIF(province, '') AS "PROVINCIA" FROM fx_stations_raw
       UNION ALL
       SELECT station_code, concat('Estación ', station_name), lat_raw, lon_raw, NULLIF(province, '') FROM fx_stations_raw""",
)
def ingest_encoding(spark, sf_dir):
    """The same list in UTF-8 and Latin-1 files side by side, read as one."""
    run = Run(spark)
    stations = _stations(spark, sf_dir)
    write_csv(stations, f"{run.raw}/list.csv", encoding="UTF-8")
    write_csv(stations, f"{run.raw}/list.csv", mode="append")
    return read_csv_flexible(spark, f"{run.raw}/list.csv", sep=",")


@query(
    "clean_headers",
    """SELECT trip_id, route_id, direction_id, 'trip_id,route_id,direction_id' AS columns FROM fx_trips""",
)
def clean_headers(spark, sf_dir):
    """Headers with a byte-order mark and blanks around the names."""
    run = Run(spark)
    trips = views.frame(spark, sf_dir, "fx_trips").select("trip_id", "route_id", "direction_id")
    write_csv(trips.toDF("\ufefftrip_id ", "  route_id", "direction_id\t"), f"{run.raw}/trips.csv", encoding="UTF-8")
    rows = read_csv_flexible(spark, f"{run.raw}/trips.csv")
    return rows.withColumn("columns", F.lit(",".join(rows.columns)))


@query(
    "read_documents",
    """SELECT 'object' AS kind, entity_id AS id, trip_id FROM fx_feed_flat WHERE entity_id IS NOT NULL
       UNION ALL SELECT 'array', link, paragraph FROM fx_incidents""",
)
def read_documents(spark, sf_dir):
    """Whole-file JSON: documents of objects, and notices that must be arrays."""
    run = Run(spark)
    feed = views.trip_feed(spark, sf_dir, "A").unionByName(views.trip_feed(spark, sf_dir, "B"))
    write_documents(numbered(feed), "key", f"{run.raw}/feed.json")
    write_documents(views.frame(spark, sf_dir, "fx_incidents"), "page_id", f"{run.raw}/notices.json")
    entities = read_document(spark, f"{run.raw}/feed.json", schemas.TRIP_FEED).select(F.explode("entity").alias("e"))
    notices = read_array_document(spark, f"{run.raw}/notices.json", schemas.INCIDENTS)
    return entities.select(F.lit("object").alias("kind"), "e.id", F.col("e.tripUpdate.trip.tripId").alias("trip_id")).unionByName(
        notices.select(F.lit("array").alias("kind"), F.col("link").alias("id"), F.col("paragraph").alias("trip_id"))
    )


@query(
    "rescue_documents",
    """SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(route_count AS INTEGER) END AS route_count,
              CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN '{"route_count":"many","note":"n' || id || '"}'
                   ELSE '{"note":"n' || id || '"}' END AS _rescued_data
       FROM fx_alerts""",
)
def rescue_documents(spark, sf_dir):
    """Undeclared fields and values of the wrong type are kept as JSON."""
    alerts = views.frame(spark, sf_dir, "fx_alerts")
    count = F.when(F.col("id").cast("bigint") % 3 == 0, F.lit('"many"')).otherwise(F.col("route_count").cast("string"))
    text = F.concat(F.lit('{"id":"'), "id", F.lit('","route_count":'), count, F.lit(',"note":"n'), "id", F.lit('"}'))
    declared = StructType(schemas.ALERTS.fields[:2])
    rows = parse_documents(alerts.select(text.alias("value")), declared)
    return rows.select("id", "route_count", RESCUED)


@query(
    "bronze_to_bundle",
    f"""SELECT 'station' AS kind, station_code AS key, CAST(lat AS VARCHAR) AS value FROM (
          SELECT station_code, {sql_number("lat_raw")} AS lat, {sql_number("lon_raw")} AS lon FROM fx_stations_raw) s
        WHERE lat IS NOT NULL AND lon IS NOT NULL
        UNION ALL SELECT 'trip', trip_id, CAST(COALESCE(TRY_CAST(direction_id AS INTEGER), 0) AS VARCHAR) FROM fx_trips""",
)
def bronze_to_bundle(spark, sf_dir):
    """Raw files to bronze tables to the dataset bundle."""
    run = Run(spark)
    write_csv(_stations(spark, sf_dir), f"{run.raw}/listado_completo_av_ld_md.csv")
    write_csv(views.frame(spark, sf_dir, "fx_trips"), f"{run.raw}/fomento_transit/trips.txt", ",", "UTF-8")
    run.load()
    data = load_tables(spark, run.database)
    stations = data["avld"].select(
        F.lit("station").alias("kind"), F.col("station_code").alias("key"), F.col("lat").cast("string").alias("value")
    )
    trips = data["gtfs_trips"].select(
        F.lit("trip").alias("kind"), F.col("trip_id").alias("key"), F.col("direction_id").cast("string").alias("value")
    )
    return stations.unionByName(trips)


@query(
    "curated_updates",
    """SELECT CASE service WHEN 'A' THEN 'Cercanias' ELSE 'LD' END AS feed, CAST(feed_ts AS DATE) AS service_date,
              count(*) AS updates, count(entity_id) AS with_entity
       FROM fx_feed_flat GROUP BY 1, 2""",
)
def curated_updates(spark, sf_dir):
    """Raw feeds to bronze to curated tables, then updates per feed and service date."""
    run = Run(spark)
    write_feeds(run, sf_dir)
    write_csv(_stations(spark, sf_dir), f"{run.raw}/estaciones.csv")
    run.load()
    curated = f"curated_{run.database}"
    write_curated(spark, run.database, curated, f"{run.location}_curated")
    return spark.table(f"{curated}.trip_updates_rt").groupBy("feed", "service_date").agg(
        F.count(F.lit(1)).alias("updates"), F.count("entity_id").alias("with_entity")
    )


@query(
    "curated_increments",
    """SELECT service_date, CAST(CASE WHEN again THEN 2 * n ELSE n END AS BIGINT) AS updates,
              CASE WHEN again THEN 'added' ELSE 'kept' END AS files
       FROM (SELECT CAST(feed_ts AS DATE) AS service_date, date_diff('day', DATE '1970-01-01', CAST(feed_ts AS DATE)) % 5 = 0 AS again,
                    count(*) AS n FROM fx_feed_flat WHERE service = 'A' GROUP BY 1, 2) d""",
)
def curated_increments(spark, sf_dir):
    """Two deliveries: the second brings the updates of every fifth day again. Files of other days stay, and so do all old ones."""
    run = Run(spark)
    feed = views.trip_feed(spark, sf_dir, "A")
    day = F.datediff(F.to_date(F.timestamp_seconds(F.col("header.timestamp").cast("bigint"))), F.lit("1970-01-01"))
    target = f"curated_{run.database}"

    def delivered(rows: DataFrame) -> DataFrame:
        write_documents(numbered(rows), "key", f"{run.raw}/trip_updates.json", mode="append")
        run.load()
        write_curated(spark, run.database, target, f"{run.location}_curated")
        spark.catalog.refreshTable(f"{target}.trip_updates_rt")
        rows = spark.table(f"{target}.trip_updates_rt")
        return checkpointed(rows.groupBy("service_date", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")))

    first, second = delivered(feed), delivered(feed.where(day % 5 == 0))
    lost = first.join(second, "file", "left_anti").count()
    new = second.join(first, "file", "left_anti").select("file", F.lit(1).alias("new"))
    dates = second.join(new, "file", "left").groupBy("service_date").agg(F.sum("n").alias("updates"), F.max("new").alias("new"))
    state = F.when(F.lit(lost > 0), "lost").when(F.col("new") == 1, "added").otherwise("kept")
    return dates.select("service_date", "updates", state.alias("files"))


@query(
    "ingest_feed_fidelity",
    """SELECT entity_id, trip_id, route_id, bearing, first_delay, second_delay,
              CASE WHEN event_id % 10 = 0 THEN 'late' END AS rescued_delay
       FROM (SELECT event_id, CAST(event_id AS VARCHAR) AS entity_id, CAST(event_id * 2 AS VARCHAR) AS trip_id,
                    concat('R', event_id % 50) AS route_id, CAST(event_id % 360 + 0.5 AS DOUBLE) AS bearing,
                    event_id % 60 AS first_delay, event_id % 60 + 30 AS second_delay FROM events) e""",
)
def ingest_feed_fidelity(spark, sf_dir):
    """Live feeds with fields nobody declared, a text where a number belongs and two stops: all of it is kept."""
    run = Run(spark)
    events = views.frame(spark, sf_dir, "events")
    number = F.col("event_id")
    stop = lambda delay: F.struct(F.struct(delay.alias("delay"), F.lit(5).alias("uncertainty")).alias("arrival"))
    update = F.struct(
        F.struct((number * 2).cast("string").alias("tripId"), F.concat(F.lit("R"), number % 50).alias("routeId")).alias("trip"),
        F.struct((number % 360 + 0.5).cast("double").alias("bearing")).alias("vehicle"),
        F.when(number % 10 == 0, "late").alias("delay"),
        F.array(stop(number % 60), stop(number % 60 + 30)).alias("stopTimeUpdate"),
    )
    entity = F.struct(number.cast("string").alias("id"), update.alias("tripUpdate"))
    documents = events.select(F.array(entity).alias("entity"), number.alias("key"))
    write_documents(documents, "key", f"{run.raw}/trip_updates.json")
    run.load()
    rows = run.table("bronze_json_trip_updates").select("rescued_data", F.explode("entity").alias("e"))
    lost = F.get_json_object(F.get_json_object("rescued_data", "$.entity"), "$[0].tripUpdate.delay")
    stops = F.col("e.tripUpdate.stopTimeUpdate")
    return rows.select(
        F.col("e.id").alias("entity_id"),
        F.col("e.tripUpdate.trip.tripId").alias("trip_id"),
        F.col("e.tripUpdate.trip.routeId").alias("route_id"),
        F.col("e.tripUpdate.vehicle.bearing").alias("bearing"),
        stops[0]["arrival"]["delay"].alias("first_delay"),
        stops[1]["arrival"]["delay"].alias("second_delay"),
        lost.alias("rescued_delay"),
    )


@query(
    "ingest_header_order",
    """SELECT trip_id, route_id, direction_id, CAST(NULL AS VARCHAR) AS rescued_data FROM fx_trips
       UNION ALL SELECT concat('b', trip_id), route_id, NULL, CASE WHEN direction_id IS NOT NULL
         THEN concat('{"heading":"', direction_id, '"}') END FROM fx_trips""",
)
def ingest_header_order(spark, sf_dir):
    """Two deliveries of one table with their columns in another order, one under another name."""
    run = Run(spark)
    trips = views.frame(spark, sf_dir, "fx_trips")
    write_csv(trips, f"{run.raw}/trips.csv")
    run.load()
    other = trips.select(F.col("direction_id").alias("heading"), "route_id", F.concat(F.lit("b"), "trip_id").alias("trip_id"))
    write_csv(other, f"{run.raw}/trips.csv", mode="append")
    run.load()
    return run.table("bronze_csv_trips").select("trip_id", "route_id", "direction_id", "rescued_data")


@query(
    "ingest_accounting",
    """SELECT kind, count(*) AS files FROM (
         SELECT doc_id, unnest(['listed', CASE doc_id % 4 WHEN 0 THEN 'loaded' ELSE 'uncovered' END]) AS kind FROM documents) f
       GROUP BY kind""",
)
def ingest_accounting(spark, sf_dir):
    """Listed files are those loaded and those reported: foreign files, sub-folders and hidden names in a dataset folder.

    One file per document; its place in the folder follows from the id.
    """
    run = Run(spark)
    docs = views.frame(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("value"), "doc_id")
    for number, place in enumerate(("list.csv", "list.csv/sub", "list.csv/notes", "other")):
        write_single(docs.filter(F.col("doc_id") % 4 == number).select("value"), f"{run.raw}/{place}")
    specs = run.load()
    files = checkpointed(list_files(spark, run.raw))
    hidden = len([p for p in hidden_files(spark, run.raw, files) if not p.endswith(("_SUCCESS", ".crc"))])
    listed = files.count() + hidden
    loaded = route_files(files).join(
        spark.createDataFrame([(s.dataset,) for s in specs], "dataset string"), "dataset", "left_semi"
    )
    left = coverage(spark, run.raw).filter(~F.col("rel_path").rlike(r"(_SUCCESS|\.crc)$"))
    counts = [("listed", listed), ("loaded", loaded.count()), ("uncovered", left.count())]
    return spark.createDataFrame(counts, "kind string, files long")


NUMBERED_LISTS = f"""(SELECT list_no, {sql_number("lat_raw")} AS lat, {sql_number("lon_raw")} AS lon FROM fx_stations_raw) l"""


@query(
    "curated_bundle",
    f"""SELECT dataset, n AS bronze_rows, n AS curated_rows, CAST(0 AS BIGINT) AS differing FROM (
               SELECT 'stations' AS dataset, count(*) AS n FROM {NUMBERED_LISTS} WHERE list_no = 0 AND lat IS NOT NULL AND lon IS NOT NULL
               UNION ALL SELECT 'avld', count(*) FROM {NUMBERED_LISTS} WHERE list_no = 1 AND lat IS NOT NULL AND lon IS NOT NULL
               UNION ALL SELECT 'feve', count(*) FROM {NUMBERED_LISTS} WHERE list_no = 2 AND lat IS NOT NULL AND lon IS NOT NULL
               UNION ALL SELECT 'cercanias_madrid', count(*) FROM {NUMBERED_LISTS} WHERE list_no = 3 AND lat IS NOT NULL AND lon IS NOT NULL
               UNION ALL SELECT 'gtfs_stops', count(*) FROM fx_stations_raw
               UNION ALL SELECT 'gtfs_routes', count(*) FROM fx_routes
               UNION ALL SELECT 'gtfs_trips', count(*) FROM fx_trips
               UNION ALL SELECT 'trip_updates', count(*) FROM fx_feed_flat
               UNION ALL SELECT 'vehicles', count(*) FROM fx_vehicles WHERE lat IS NOT NULL AND lon IS NOT NULL
               UNION ALL SELECT 'alerts', count(*) FROM fx_alerts
               UNION ALL SELECT 'incidents', count(*) FROM fx_incidents
               UNION ALL SELECT 'atendo', count(*) FROM fx_access
               UNION ALL SELECT 'train_info', count(*) FROM fx_train_info) sized""",
)
def curated_bundle(spark, sf_dir):
    """All thirteen datasets of a full folder, from bronze and from the curated layer, row by row.

    Documents come compressed: as plain text those of the vehicles are twelve times the table they are made of. Each dataset
    is compared before the next, so that only one's hashes lie on disk.
    """
    run = Run(spark)
    raw = views.frame(spark, sf_dir, "fx_stations_raw")
    files = ("estaciones", "listado_completo_av_ld_md", "listado-de-estaciones-feve-2", "listado-estaciones-cercanias-madrid")
    for number, name in enumerate(files):
        own = raw.filter(F.col("list_no") == number)
        named = own.select(
            F.col("station_code").alias("CODIGO"), F.col("station_name").alias("DESCRIPCION"),
            F.col("lat_raw").alias("LATITUD"), F.col("lon_raw").alias("LONGITUD"), F.col("province").alias("PROVINCIA"),
        )
        write_csv(named, f"{run.raw}/{name}.csv")
    stops = raw.select(
        F.col("station_code").alias("stop_id"), F.col("station_name").alias("stop_name"),
        F.col("lat_raw").alias("stop_lat"), F.col("lon_raw").alias("stop_lon"),
    )
    for name, rows in (("stops", stops), ("routes", views.frame(spark, sf_dir, "fx_routes")), ("trips", views.frame(spark, sf_dir, "fx_trips"))):
        write_csv(rows, f"{run.raw}/google_transit/{name}.txt", ",", "UTF-8")
    write_csv(views.frame(spark, sf_dir, "fx_access"), f"{run.raw}/listado-de-estaciones-con-servicio-de-atendo.csv")
    write_csv(views.frame(spark, sf_dir, "fx_train_info"), f"{run.raw}/informacion_trenes.csv")
    write_feeds(run, sf_dir, "gzip")
    vehicles = views.vehicle_feed(spark, sf_dir)
    write_documents(numbered(vehicles), "key", f"{run.raw}/vehicle_positions.json", compression="gzip")
    alerts = views.alert_feed(spark, sf_dir).withColumn("key", F.get("entity.id", F.lit(0)).cast("bigint"))
    write_documents(alerts, "key", f"{run.raw}/alerts.json", compression="gzip")
    write_documents(views.frame(spark, sf_dir, "fx_incidents"), "page_id", f"{run.raw}/rfincidentreports_co.noticeresults.json", compression="gzip")
    run.load()
    target = f"curated_{run.database}"
    write_curated(spark, run.database, target, f"{run.location}_curated")
    bronze, curated = load_tables(spark, run.database), load_tables(spark, target)
    alone, out = tidy(spark), None
    for key in bronze:
        columns = [c for c in bronze[key].columns if not c.startswith("_")]
        sides = [layer[key].select(F.xxhash64(*columns).alias("h"), F.lit(one).alias("one")) for layer, one in ((bronze, 1), (curated, -1))]
        both = sides[0].unionByName(sides[1]).groupBy("h").agg(
            F.count_if(F.col("one") == 1).alias("b"), F.count_if(F.col("one") == -1).alias("c")
        )
        row = both.agg(
            F.lit(key).alias("dataset"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("bronze_rows"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("curated_rows"),
            F.coalesce(F.sum(F.abs(F.col("b") - F.col("c"))), F.lit(0)).alias("differing"),
        )
        row = in_session(checkpointed(in_session(row, alone)), spark)
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "ingest_inventory",
    """SELECT 'bronze_csv_estaciones' AS table_name, 'EXTERNAL' AS table_type, 'PARQUET' AS data_source_format,
              'Bronze' AS layer, 'csv' AS domain
       UNION ALL SELECT 'bronze_google_transit_trips', 'EXTERNAL', 'PARQUET', 'Bronze', 'google'""",
)
def ingest_inventory(spark, sf_dir):
    """The catalog's own listing of the tables a load made."""
    run = Run(spark)
    write_csv(_stations(spark, sf_dir), f"{run.raw}/estaciones.csv")
    write_csv(views.frame(spark, sf_dir, "fx_trips"), f"{run.raw}/google_transit/trips.txt", ",", "UTF-8")
    run.load()
    return table_inventory(spark, run.database)


@query(
    "files_to_bundle",
    f"""SELECT 'stations' AS dataset, count(*) AS rows FROM (
          SELECT DISTINCT trim(station_code) AS code, lat, lon FROM (
            SELECT station_code, {sql_number("replace(lat_raw, ',', '.')")} AS lat,
                   {sql_number("replace(lon_raw, ',', '.')")} AS lon FROM fx_stations_raw) r
          WHERE lat <> 0 AND lon <> 0) s
        UNION ALL SELECT 'trip_updates', count(*) FROM fx_feed_flat WHERE entity_id IS NOT NULL
        UNION ALL SELECT 'alerts', count(*) FROM fx_alerts
        UNION ALL SELECT 'gtfs_trips', count(*) FROM fx_trips
        UNION ALL SELECT 'vehicles', 0""",
)
def files_to_bundle(spark, sf_dir):
    """A raw folder read directly; rows per dataset, one of them without a file."""
    run = Run(spark)
    write_csv(_stations(spark, sf_dir).withColumnRenamed("CÓDIGO", "CODIGO"), f"{run.raw}/estaciones.csv")
    write_feeds(run, sf_dir)
    alerts = views.alert_feed(spark, sf_dir).withColumn("key", F.get("entity.id", F.lit(0)).cast("bigint"))
    write_documents(alerts, "key", f"{run.raw}/alerts.json")
    write_csv(views.frame(spark, sf_dir, "fx_trips"), f"{run.raw}/google_transit/trips.txt", ",", "UTF-8")
    data = load_files(spark, run.raw)
    return row_counts({k: data[k] for k in ("stations", "trip_updates", "alerts", "gtfs_trips", "vehicles")}).withColumnsRenamed(
        {"metric": "dataset", "value": "rows"}
    )


@query(
    "broken_sources",
    """SELECT 'rows' AS kind, 'trip_updates' AS dataset, CAST(count(*) AS VARCHAR) AS value FROM fx_feed_flat
         WHERE service = 'A' AND entity_id IS NOT NULL
       UNION ALL SELECT 'rows', 'alerts', '0' UNION ALL SELECT 'rows', 'stations', '0' UNION ALL SELECT 'rows', 'atendo', '0'
       UNION ALL SELECT 'rows', 'gtfs_trips', CAST(count(*) AS VARCHAR) FROM fx_trips
       UNION ALL SELECT 'reject', 'alerts', 'no JSON' UNION ALL SELECT 'reject', 'trip_updates', 'no JSON'
       UNION ALL SELECT 'reject', 'stations', 'no text' UNION ALL SELECT 'reject', 'atendo', 'missing'""",
)
def broken_sources(spark, sf_dir):
    """A folder with sound files, truncated JSON, binary data called .csv and a missing list: what is read and what is told."""
    run = Run(spark)
    feed = views.trip_feed(spark, sf_dir, "A")
    write_documents(numbered(feed), "key", f"{run.raw}/trip_updates.json")
    alerts = views.alert_feed(spark, sf_dir)
    # One document that ends in its first alert; every alert is looked at where it lies.
    text = alerts.agg(F.concat(F.lit('{"entity":['), F.substring(F.min(F.to_json(F.struct(*alerts.columns))), 1, 100)).alias("value"))
    text.write.text(f"{run.raw}/alerts.json")
    text.write.mode("append").text(f"{run.raw}/trip_updates.json")
    pages = views.frame(spark, sf_dir, "fx_incidents").select(F.concat("paragraph", F.lit("\0")).alias("value"))
    pages.write.text(f"{run.raw}/estaciones.csv")
    write_csv(views.frame(spark, sf_dir, "fx_trips"), f"{run.raw}/google_transit/trips.txt", ",", "UTF-8")
    data = load_files(spark, run.raw)
    names = ("trip_updates", "alerts", "stations", "atendo", "gtfs_trips")
    rows = row_counts({k: data[k] for k in names}).select(
        F.lit("rows").alias("kind"), F.col("metric").alias("dataset"), F.col("value").cast("string").alias("value")
    )
    rejects = rejected_files(spark, run.raw).filter(F.col("source").isin("alerts.json", "trip_updates.json", "estaciones.csv") | (F.col("dataset") == "atendo"))
    # A source may consist of many broken parts.
    told = rejects.select(F.lit("reject").alias("kind"), "dataset", F.col("reason").alias("value")).distinct()
    return rows.unionByName(told)


@query(
    "sql_to_bundle",
    """SELECT 'trip_updates' AS dataset, CAST(event_id AS VARCHAR) AS key, value * 60.0 AS amount FROM events
       UNION ALL SELECT 'gtfs_routes', CAST(c_custkey AS VARCHAR), 0.0 FROM customer""",
)
def sql_to_bundle(spark, sf_dir):
    """Datasets from user SQL, with the column names users happen to choose."""
    views.frame(spark, sf_dir, "events")
    views.frame(spark, sf_dir, "customer")
    data = load_queries(
        spark,
        {
            "trip_updates": "SELECT event_id AS tripid, value AS delay_minutes, ts, event_type AS line FROM events",
            "gtfs_routes": "SELECT c_custkey AS id, c_mktsegment AS service FROM customer",
        },
    )
    updates = data["trip_updates"].select(
        F.lit("trip_updates").alias("dataset"), F.col("trip_id").alias("key"), F.col("delay_seconds").alias("amount")
    )
    routes = data["gtfs_routes"].select(
        F.lit("gtfs_routes").alias("dataset"), F.col("route_id").alias("key"), F.lit(0.0).alias("amount")
    )
    return updates.unionByName(routes)
