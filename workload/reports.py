"""Queries: KPIs, distributions, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.functions import STRICT_YES
from trackline.operators import counts, distributions, rankings
from trackline.operators.filters import in_map_window
from trackline.operators.stations import station_master
from trackline.plans.marts import filter_values
from trackline.sources.tables import with_layer_and_domain
from workload import views
from workload.datasets import MASTER, TABLES
from workload.registry import ntz, query, rounded, sql_label

DELAY = "COALESCE(delay_seconds, 0)"
MINUTES = f"({DELAY} / 60.0)"


@query(
    "top_delayed_trips",
    """SELECT feed, trip_id, round_even(delay_seconds / 60.0, 1) AS delay_min, timestamp FROM fx_updates
       ORDER BY delay_seconds DESC NULLS LAST, trip_id NULLS LAST, feed, timestamp NULLS LAST LIMIT 20""",
)
def top_delayed_trips(spark, sf_dir):
    return ntz(rankings.top_delayed_trips(views.frame(spark, sf_dir, "fx_updates")), "timestamp")


@query(
    "kpi_overview",
    f"""SELECT 'stations' AS metric, count(DISTINCT station_code) AS value FROM ({MASTER}) m
        UNION ALL SELECT 'provinces', count(DISTINCT {sql_label("province")}) FROM ({MASTER}) m
        UNION ALL SELECT 'train_models', count(DISTINCT modelo) FROM fx_train_info
        UNION ALL SELECT 'atendo_stations', count(*) FROM fx_access""",
)
def kpi_overview(spark, sf_dir):
    data = views.bundle(spark, sf_dir, "atendo", "train_info")
    return counts.overview_kpis(station_master(data), data["atendo"], data["train_info"])


@query(
    "kpi_ops",
    """SELECT 'stations' AS metric, count(*) AS value FROM fx_stations WHERE list_no = 0
       UNION ALL SELECT 'routes', count(*) FROM fx_routes
       UNION ALL SELECT 'scheduled_trips', count(*) FROM fx_trips
       UNION ALL SELECT 'trip_updates', count(*) FROM fx_updates
       UNION ALL SELECT 'vehicles', count(*) FROM fx_vehicles
       UNION ALL SELECT 'alerts', count(*) FROM fx_alerts
       UNION ALL SELECT 'incidents', count(*) FROM fx_incidents
       UNION ALL SELECT 'distinct_trips', count(DISTINCT trip_id) FROM fx_trips""",
)
def kpi_ops(spark, sf_dir):
    return counts.operations_kpis(views.bundle(spark, sf_dir))


@query(
    "kpi_distinct_approx",
    """SELECT 'distinct_trips' AS metric, count(DISTINCT trip_id) AS exact, true AS close FROM fx_updates
       UNION ALL SELECT 'distinct_feeds', count(DISTINCT feed), true FROM fx_updates""",
)
def kpi_distinct_approx(spark, sf_dir):
    """Distinct counts from sketches kept per service date and merged: the exact number, and whether 5 % holds."""
    updates = views.frame(spark, sf_dir, "fx_updates")
    metrics = {"distinct_trips": F.col("trip_id"), "distinct_feeds": F.col("feed")}
    sketches = counts.distinct_sketches(updates, F.to_date("timestamp"), metrics)
    both = counts.merged_distinct_counts(sketches, list(metrics)).withColumnRenamed("value", "estimate").join(
        counts.distinct_counts(updates, metrics).withColumnRenamed("value", "exact"), "metric"
    )
    return both.select("metric", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query(
    "kpi_delay",
    """SELECT count(*) FILTER (WHERE delay_seconds > 0) AS delayed_trips,
              round(COALESCE(avg(CASE WHEN delay_seconds > 0 THEN delay_seconds END), 0) / 60, 6) AS avg_delay_min
       FROM fx_updates""",
)
def kpi_delay(spark, sf_dir):
    return rounded(counts.delay_kpis(views.frame(spark, sf_dir, "fx_updates")), "avg_delay_min")


@query(
    "stations_by_province",
    f"""SELECT {sql_label("province")} AS province, count(*) AS stations FROM ({MASTER}) m GROUP BY 1
        ORDER BY stations DESC, 1 LIMIT 20""",
)
def stations_by_province(spark, sf_dir):
    return counts.stations_by_province(station_master(views.station_lists(spark, sf_dir)))


@query(
    "stations_by_raw_province",
    """SELECT province, count(*) AS stations FROM fx_stations GROUP BY 1
       ORDER BY stations DESC, province NULLS LAST LIMIT 15""",
)
def stations_by_raw_province(spark, sf_dir):
    return counts.stations_by_raw_province(views.frame(spark, sf_dir, "fx_stations"))


SOURCE_PROVINCE = """
    SELECT source, province, count(*) AS stations FROM fx_stations GROUP BY 1, 2
    ORDER BY stations DESC, source NULLS LAST, province NULLS LAST LIMIT 50"""


@query("stations_by_source_province", SOURCE_PROVINCE)
def stations_by_source_province(spark, sf_dir):
    return counts.stations_by_source_province(views.frame(spark, sf_dir, "fx_stations"))


@query(
    "source_totals",
    f"""SELECT source, CAST(sum(stations) AS BIGINT) AS stations, count(*) AS provinces
        FROM ({SOURCE_PROVINCE}) s GROUP BY 1""",
)
def source_totals(spark, sf_dir):
    return counts.source_totals(stations_by_source_province(spark, sf_dir))


@query(
    "models_by_constructor",
    f"""SELECT {sql_label("constructor")} AS constructor, count(*) AS models FROM fx_train_info GROUP BY 1
        ORDER BY models DESC, 1 LIMIT 15""",
)
def models_by_constructor(spark, sf_dir):
    return counts.models_by_constructor(views.frame(spark, sf_dir, "fx_train_info"))


@query(
    "purpose_mix",
    f"""SELECT {sql_label("proposito")} AS purpose, count(*) AS models FROM fx_train_info GROUP BY 1
        ORDER BY models DESC, 1 LIMIT 15""",
)
def purpose_mix(spark, sf_dir):
    return counts.purpose_mix(views.frame(spark, sf_dir, "fx_train_info"))


@query(
    "vehicle_status",
    f"SELECT {sql_label('status', 'UNKNOWN')} AS status, count(*) AS vehicles FROM fx_vehicles GROUP BY 1",
)
def vehicle_status(spark, sf_dir):
    return counts.vehicle_status(views.frame(spark, sf_dir, "fx_vehicles"))


@query(
    "vehicle_status_by_key",
    f"SELECT {sql_label('status', 'UNKNOWN')} AS status, count(*) AS count FROM fx_vehicles GROUP BY 1",
)
def vehicle_status_by_key(spark, sf_dir):
    return counts.vehicle_status_by_key(views.frame(spark, sf_dir, "fx_vehicles"))


@query(
    "service_mix",
    f"""SELECT service, routes, round(routes / sum(routes) OVER (), 6) AS share FROM (
          SELECT {sql_label("route_short_name")} AS service, count(*) AS routes FROM fx_routes GROUP BY 1
          ORDER BY routes DESC, service LIMIT 12) s""",
)
def service_mix(spark, sf_dir):
    top = counts.service_mix(views.frame(spark, sf_dir, "fx_routes"))
    return rounded(counts.with_share(top, "routes"), "share")


@query(
    "top_services",
    f"""SELECT {sql_label("route_short_name")} AS service, count(*) AS routes FROM fx_routes GROUP BY 1
        ORDER BY routes DESC, service LIMIT 15""",
)
def top_services(spark, sf_dir):
    return counts.service_mix(views.frame(spark, sf_dir, "fx_routes"), 15)


@query(
    "route_families",
    """SELECT route_short_name, count(*) AS count FROM fx_routes GROUP BY 1
       ORDER BY count DESC, route_short_name NULLS LAST LIMIT 15""",
)
def route_families(spark, sf_dir):
    return counts.route_families(views.frame(spark, sf_dir, "fx_routes"))


@query(
    "delay_severity",
    f"""SELECT CAST(r.rank AS INTEGER) AS rank, r.severity, COALESCE(c.trips, 0) AS trips,
               round(COALESCE(c.trips, 0) / sum(COALESCE(c.trips, 0)) OVER (), 6) AS share
        FROM (VALUES (0, 'On time', -1, 0), (1, '0-5 min', 0, 5), (2, '5-15 min', 5, 15), (3, '15-30 min', 15, 30),
                     (4, '30+ min', 30, 10000)) AS r(rank, severity, lo, hi)
        LEFT JOIN (SELECT lo, count(*) AS trips
                   FROM (SELECT {MINUTES} AS m FROM fx_updates) u
                   JOIN (VALUES (-1, 0), (0, 5), (5, 15), (15, 30), (30, 10000)) AS e(lo, hi) ON m > lo AND m <= hi
                   GROUP BY lo) c ON c.lo = r.lo""",
)
def delay_severity(spark, sf_dir):
    return rounded(distributions.severity_mix(views.frame(spark, sf_dir, "fx_updates")), "share")


@query(
    "delay_by_hour",
    f"""SELECT CAST(COALESCE(hour(timestamp), -1) AS INTEGER) AS hour, round(avg(round_even({MINUTES}, 2)), 6) AS delay_min
        FROM fx_updates GROUP BY 1""",
)
def delay_by_hour(spark, sf_dir):
    return rounded(distributions.delay_by_hour(views.frame(spark, sf_dir, "fx_updates")), "delay_min")


def _histogram_sql(source: str, bins: int, by: str = "") -> str:
    """Equal-width bins over ``source``, a query giving x and the optional group."""
    lead = f"{by}, " if by else ""
    return f"""
        SELECT {lead}bin, round(lo + bin * (hi - lo) / {bins}, 6) AS bin_start,
               round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS bin_end, count(*) AS n
        FROM (SELECT {lead}lo, hi, CAST(CASE WHEN lo = hi THEN 0
                       ELSE least(floor({bins} * (x - lo) / (hi - lo)), {bins - 1}) END AS INTEGER) AS bin
              FROM ({source}) d CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM ({source}) e) f WHERE x IS NOT NULL) g
        GROUP BY ALL"""


@query("delay_histogram", _histogram_sql(f"SELECT feed, {MINUTES} AS x FROM fx_updates", 30, "feed"))
def delay_histogram(spark, sf_dir):
    return rounded(distributions.delay_histogram(views.frame(spark, sf_dir, "fx_updates")), "bin_start", "bin_end")


@query("alert_histogram", _histogram_sql("SELECT CAST(route_count AS DOUBLE) AS x FROM fx_alerts", 20))
def alert_histogram(spark, sf_dir):
    return rounded(distributions.alert_histogram(views.frame(spark, sf_dir, "fx_alerts")), "bin_start", "bin_end")


@query(
    "speed_histogram",
    _histogram_sql(
        """SELECT TRY_CAST(replace(NULLIF(regexp_extract(velocidad_maxima, '(\\d+[\\.,]?\\d*)', 1), ''), ',', '.')
           AS DOUBLE) AS x FROM fx_train_info""",
        20,
    ),
)
def speed_histogram(spark, sf_dir):
    return rounded(distributions.speed_histogram(views.frame(spark, sf_dir, "fx_train_info")), "bin_start", "bin_end")


def _box_sql(group: str) -> str:
    return f"""
        SELECT feed, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
               round(min(x), 6) AS min, round(max(x), 6) AS max,
               round(min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS lower_fence,
               round(max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS upper_fence,
               count(*) FILTER (WHERE x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT {group} AS feed, {MINUTES} AS x FROM fx_updates) u
        JOIN (SELECT {group} AS feed, quantile_cont({MINUTES}, 0.25) AS q1, quantile_cont({MINUTES}, 0.5) AS median,
                     quantile_cont({MINUTES}, 0.75) AS q3 FROM fx_updates GROUP BY 1) q USING (feed)
        GROUP BY feed, q1, median, q3"""


BOX = ["q1", "median", "q3", "min", "max", "lower_fence", "upper_fence"]


@query("delay_box", _box_sql("feed"))
def delay_box(spark, sf_dir):
    return rounded(distributions.delay_box(views.frame(spark, sf_dir, "fx_updates")), *BOX)


@query(
    "delay_box_approx",
    f"""SELECT {sql_label("feed")} AS feed, count(*) AS n, unnest(['q1', 'median', 'q3']) AS quantile, true AS within
        FROM fx_updates GROUP BY 1""",
)
def delay_box_approx(spark, sf_dir):
    """Quartiles from mergeable sketches: whether each lies within 1 in 1,000 of its rank, counted exactly."""
    updates = views.frame(spark, sf_dir, "fx_updates")
    found = distributions.delay_box_approx(updates)
    minutes = distributions.minutes_by_feed(updates)
    wide = found.select("feed", "n", *[F.col(c).alias(f"v_{c}") for c in distributions.QUARTILES])
    # One row per feed: the counts below come from one scan and a join with as many rows as there are feeds.
    counted = minutes.join(wide, "feed").groupBy("feed", "n").agg(
        *[F.count_if(F.col("delay_min") < F.col(f"v_{c}")).alias(f"below_{c}") for c in distributions.QUARTILES],
        *[F.count_if(F.col("delay_min") <= F.col(f"v_{c}")).alias(f"upto_{c}") for c in distributions.QUARTILES],
    )
    share = lambda c: F.col(c) / F.col("n")
    rows = [
        F.struct(F.lit(c).alias("quantile"), ((share(f"below_{c}") <= p + 0.001) & (share(f"upto_{c}") >= p - 0.001)).alias("within"))
        for c, p in distributions.QUARTILES.items()
    ]
    return counted.select("feed", "n", F.inline(F.array(*rows)))


@query("delay_box_overall", _box_sql("'all'"))
def delay_box_overall(spark, sf_dir):
    return rounded(distributions.delay_box_overall(views.frame(spark, sf_dir, "fx_updates")), *BOX)


def _coverage_sql(pattern: str) -> str:
    features = counts.ACCESS_FEATURES
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE regexp_matches(lower({c}), '{pattern}')) AS stations FROM fx_access"
        for c in features
    )


@query("accessibility_coverage", _coverage_sql("si|yes|x|1"))
def accessibility_coverage(spark, sf_dir):
    return counts.accessibility_coverage(views.frame(spark, sf_dir, "fx_access"))


@query("accessibility_coverage_strict", _coverage_sql(STRICT_YES))
def accessibility_coverage_strict(spark, sf_dir):
    return counts.accessibility_coverage(views.frame(spark, sf_dir, "fx_access"), pattern=STRICT_YES)


@query(
    "lead_time",
    f"""SELECT lead_time, count, round(count / sum(count) OVER (), 6) AS share FROM (
          SELECT {sql_label("tiempo_de_antelacion")} AS lead_time, count(*) AS count FROM fx_access GROUP BY 1) s""",
)
def lead_time(spark, sf_dir):
    spread = counts.lead_time(views.frame(spark, sf_dir, "fx_access"))
    return rounded(counts.with_share(spread, "count"), "share")


@query(
    "map_centroid",
    f"""SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM ({MASTER}) m
        WHERE lat BETWEEN 27.0 AND 44.5 AND lon BETWEEN -19.5 AND 5.5""",
)
def map_centroid(spark, sf_dir):
    return rounded(counts.centroid(in_map_window(station_master(views.station_lists(spark, sf_dir)))), "lat", "lon")


@query(
    "network_centroid",
    """SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM (
         SELECT lat, lon FROM fx_stations UNION ALL SELECT lat, lon FROM fx_vehicles) p""",
)
def network_centroid(spark, sf_dir):
    points = counts.centroid(views.frame(spark, sf_dir, "fx_stations"), views.frame(spark, sf_dir, "fx_vehicles"))
    return rounded(points, "lat", "lon")


@query(
    "filter_values",
    f"""SELECT DISTINCT 'province' AS filter, province AS value FROM ({MASTER}) m WHERE province IS NOT NULL
        UNION ALL SELECT DISTINCT 'source', source FROM ({MASTER}) m WHERE source IS NOT NULL
        UNION ALL SELECT DISTINCT 'constructor', constructor FROM fx_train_info WHERE constructor IS NOT NULL
        UNION ALL SELECT DISTINCT 'feed', feed FROM fx_updates WHERE feed IS NOT NULL
        UNION ALL SELECT DISTINCT 'route_type', route_type FROM fx_routes WHERE route_type IS NOT NULL
        UNION ALL SELECT DISTINCT 'status', status FROM fx_vehicles WHERE status IS NOT NULL""",
)
def filter_list(spark, sf_dir):
    return filter_values(views.bundle(spark, sf_dir))


@query("tables_by_domain", f"SELECT domain, layer, count(*) AS tables FROM ({TABLES}) t GROUP BY 1, 2")
def tables_by_domain(spark, sf_dir):
    return counts.tables_by_domain(with_layer_and_domain(views.frame(spark, sf_dir, "fx_tables")))


@query(
    "inventory_kpis",
    f"""SELECT count(*) AS total_tables, count(*) FILTER (WHERE layer = 'Bronze') AS bronze_tables,
               count(DISTINCT domain) AS domains FROM ({TABLES}) t""",
)
def inventory_kpis(spark, sf_dir):
    return counts.inventory_kpis(with_layer_and_domain(views.frame(spark, sf_dir, "fx_tables")))
