"""Counts, KPIs and ranked group counts.

Group counts combine on the map side, so a group holding most rows costs one partial
row per task. Ranked results order by count, then key, which makes every limit exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackline.functions import UNANCHORED_YES, is_yes, label
from trackline.operators.columns import pick_column

# Columns that hold yes-words.
ACCESS_FEATURES = ["aparcamiento", "and_n", "aseos", "vest_bulo"]


def group_count(df: DataFrame, key: Column, key_name: str, count_name: str, top: int | None = None) -> DataFrame:
    """Rows per key, most frequent first."""
    counted = df.groupBy(key.alias(key_name)).agg(F.count(F.lit(1)).alias(count_name))
    ranked = counted.orderBy(F.desc(count_name), F.col(key_name).asc_nulls_last())
    return ranked if top is None else ranked.limit(top)


def with_share(grouped: DataFrame, count_name: str, share_name: str = "share") -> DataFrame:
    """Add each row's part of the total of the rows shown."""
    total = grouped.agg(F.sum(count_name)).scalar()
    return grouped.withColumn(share_name, F.col(count_name) / total)


def stations_by_province(stations: DataFrame, top: int = 20) -> DataFrame:
    return group_count(stations, label(F.col("province")), "province", "stations", top)


def stations_by_raw_province(stations: DataFrame, top: int = 15) -> DataFrame:
    """As above, but null and blank stay groups of their own."""
    return group_count(stations, F.col("province"), "province", "stations", top)


def stations_by_source_province(stations: DataFrame, top: int = 50) -> DataFrame:
    return (
        stations.groupBy("source", "province")
        .agg(F.count(F.lit(1)).alias("stations"))
        .orderBy(F.desc("stations"), F.col("source").asc_nulls_last(), F.col("province").asc_nulls_last())
        .limit(top)
    )


def source_totals(by_source_province: DataFrame) -> DataFrame:
    """Parent totals of the rows kept by ``stations_by_source_province``."""
    return by_source_province.groupBy("source").agg(
        F.sum("stations").alias("stations"), F.count(F.lit(1)).alias("provinces")
    )


def models_by_constructor(trains: DataFrame, top: int = 15) -> DataFrame:
    return group_count(trains, label(F.col("constructor")), "constructor", "models", top)


def purpose_mix(trains: DataFrame, top: int = 15) -> DataFrame:
    return group_count(trains, label(F.col("proposito")), "purpose", "models", top)


def vehicle_status(vehicles: DataFrame) -> DataFrame:
    return group_count(vehicles, label(F.col("status"), "UNKNOWN"), "status", "vehicles")


def vehicle_status_by_key(vehicles: DataFrame) -> DataFrame:
    """Vehicles per status in key order."""
    key = label(F.col("status"), "UNKNOWN").alias("status")
    return vehicles.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy("status")


def service_mix(routes: DataFrame, top: int = 12) -> DataFrame:
    return group_count(routes, label(F.col("route_short_name")), "service", "routes", top)


def route_families(routes: DataFrame, top: int = 15) -> DataFrame:
    """Routes per raw short name."""
    return group_count(routes, F.col("route_short_name"), "route_short_name", "count", top)


def lead_time(access: DataFrame) -> DataFrame:
    return group_count(access, label(F.col("tiempo_de_antelacion")), "lead_time", "count")


def accessibility_coverage(
    access: DataFrame, features: Sequence[str] = ACCESS_FEATURES, pattern: str = UNANCHORED_YES
) -> DataFrame:
    """Stations offering each feature; one pass for all features."""
    present = [c for c in features if pick_column(access, [c])]
    if not present:
        return access.sparkSession.createDataFrame([], "feature string, stations bigint")
    one_row = access.agg(*[F.count_if(is_yes(F.col(c).cast("string"), pattern)).alias(c) for c in present])
    return one_row.unpivot([], present, "feature", "stations").orderBy(F.desc("stations"), "feature")


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One (metric, value) row per dataset."""
    rows = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(k).alias("metric"), "value") for k, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def distinct_counts(df: DataFrame, metrics: dict[str, Column], approximate: bool = False) -> DataFrame:
    """One (metric, value) row per expression, all in one pass; nulls do not count."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    one_row = df.agg(*[counter(c).alias(k) for k, c in metrics.items()])
    return one_row.unpivot([], list(metrics), "metric", "value")


def overview_kpis(stations: DataFrame, access: DataFrame, trains: DataFrame) -> DataFrame:
    """Distinct stations, provinces and train models, and accessible stations."""
    of_stations = {"stations": F.col("station_code"), "provinces": label(F.col("province"))}
    return (
        distinct_counts(stations, of_stations)
        .unionByName(distinct_counts(trains, {"train_models": F.col("modelo")}))
        .unionByName(row_counts({"atendo_stations": access}))
    )


def operations_kpis(bundle: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the live datasets and the number of distinct scheduled trips."""
    names = {
        "stations": "stations",
        "routes": "gtfs_routes",
        "trip_updates": "trip_updates",
        "vehicles": "vehicles",
        "alerts": "alerts",
        "incidents": "incidents",
    }
    # One scan of the trips for both of their numbers.
    trips = bundle["gtfs_trips"].agg(
        F.count(F.lit(1)).alias("scheduled_trips"), F.count_distinct("trip_id").alias("distinct_trips")
    )
    both = trips.unpivot([], ["scheduled_trips", "distinct_trips"], "metric", "value")
    return row_counts({k: bundle[n] for k, n in names.items()}).unionByName(both)


def distinct_sketches(df: DataFrame, by: Column, metrics: dict[str, Column], bits: int = 14) -> DataFrame:
    """A HyperLogLog sketch per expression and value of ``by``, such as a service date; nulls do not count.

    The rows can be kept, and those of new dates added; a sketch has at most 2 ** ``bits`` bytes.
    """
    return df.groupBy(by.alias("part")).agg(*[F.hll_sketch_agg(c.cast("string"), bits).alias(k) for k, c in metrics.items()])


def merged_distinct_counts(sketches: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One (metric, value) row per sketch column of ``distinct_sketches``, over all parts: estimates within some 2 %."""
    one_row = sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(k)).alias(k) for k in metrics])
    return one_row.unpivot([], list(metrics), "metric", "value")


def delay_kpis(updates: DataFrame) -> DataFrame:
    """Updates running late and their mean delay in minutes (0 when none is late)."""
    delay = F.coalesce(F.col("delay_seconds"), F.lit(0.0))
    return updates.agg(
        F.count_if(delay > 0).alias("delayed_trips"),
        (F.coalesce(F.avg(F.when(delay > 0, delay)), F.lit(0.0)) / 60).alias("avg_delay_min"),
    )


def tables_by_domain(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("domain", "layer").agg(F.count(F.lit(1)).alias("tables")).orderBy("domain", "layer")


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("layer") == "Bronze").alias("bronze_tables"),
        F.count_distinct("domain").alias("domains"),
    )


def centroid(*points: DataFrame) -> DataFrame:
    """Mean coordinates over the union of point datasets."""
    rows = reduce(DataFrame.unionByName, [p.select("lat", "lon") for p in points])
    return rows.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(filter, value) per distinct value of each column, all in one aggregate; null is no choice."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    if len(columns) == 1:
        rows = texts.distinct()
    else:
        rows = texts.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count(F.lit(1)).alias("_rows"))
    # A row has a value in the column of its own set only.
    pairs = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).where(F.col("value").isNotNull())
