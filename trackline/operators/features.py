"""Feature table of the delay model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackline.functions import (
    hour_of_day,
    integer,
    label,
    month_of_year,
    number,
    parse_timestamp,
    time_bucket,
    weekday,
)
from trackline.operators.joins import SALTS, salted_left_join
from trackline.session import checkpointed

# The features of the model with their kinds, and its label.
FEATURE_KINDS = {
    "feed": "category",
    "day_of_week": "number",
    "hour": "number",
    "is_weekend": "number",
    "month": "number",
    "time_bucket": "category",
    "route_type": "category",
    "route_short_name": "category",
    "direction_id": "number",
    "has_vehicle_position": "number",
    "vehicle_status_mode": "category",
    "vehicle_records": "number",
}
LABEL = "delay_seconds"
FEATURES = list(FEATURE_KINDS)
CATEGORICAL = [c for c, kind in FEATURE_KINDS.items() if kind == "category"]
NUMERIC = [c for c, kind in FEATURE_KINDS.items() if kind == "number"]
# Fewest rows a model is trained on.
MIN_ROWS = 30


def calendar_features(updates: DataFrame) -> DataFrame:
    """Add hour, weekday, weekend flag, month and part of the day."""
    ts = F.col("timestamp")
    hour, day = hour_of_day(ts, 0), weekday(ts)
    return updates.withColumns(
        {
            "hour": hour,
            "day_of_week": day,
            "is_weekend": (day >= 5).cast("int"),
            "month": month_of_year(ts),
            "time_bucket": time_bucket(hour),
        }
    )


def trip_vehicle_features(vehicles: DataFrame) -> DataFrame:
    """Per trip: most frequent status (lowest among ties) and number of positions.

    Counting per (trip, status) first keeps the state of a trip with very many
    positions at one row per status.
    """
    trip = _text_or(vehicles, "trip_id", None)
    if "trip_id" in vehicles.columns:
        trip = F.coalesce(trip, F.lit(""))
    by_status = vehicles.groupBy(trip.alias("trip_id"), _text_or(vehicles, "status", None).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Smallest (-count, status) is the mode; rows without a status sort last.
    order = F.struct(F.col("status").isNull().alias("missing"), (-F.col("n")).alias("n"), F.col("status"))
    return (
        by_status.groupBy("trip_id")
        .agg(F.sum("n").alias("vehicle_records"), F.min(order).alias("top"))
        .select(
            "trip_id",
            F.lit(1).alias("has_vehicle_position"),
            F.coalesce(F.col("top.status"), F.lit("UNKNOWN")).alias("vehicle_status_mode"),
            "vehicle_records",
        )
    )


def _text_or(df: DataFrame, name: str, default: str | None) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(default).cast("string")


def with_row_number(updates: DataFrame, name: str = "row_number") -> DataFrame:
    """Materialise the updates with a unique number per row, whatever ids they lack or repeat."""
    return checkpointed(updates.withColumn(name, F.monotonically_increasing_id()))


def _trip_lookup(trips: DataFrame, unique: bool) -> DataFrame:
    lookup = trips.select(
        _text_or(trips, "trip_id", None).alias("trip_id"),
        _text_or(trips, "route_id", "").alias("route_id"),
        integer(trips, "direction_id" if "direction_id" in trips.columns else None).alias("direction_id"),
    )
    return _numbered(_one_per_key(lookup, "trip_id") if unique else lookup, "trip_id", "trip_copy")


def _route_lookup(routes: DataFrame, unique: bool) -> DataFrame:
    lookup = routes.select(
        _text_or(routes, "route_id", None).alias("route_id"),
        _text_or(routes, "route_type", "Unknown").alias("route_type"),
        _text_or(routes, "route_short_name", "Unknown").alias("route_short_name"),
    )
    return _numbered(_one_per_key(lookup, "route_id") if unique else lookup, "route_id", "route_copy")


def _one_per_key(lookup: DataFrame, key: str) -> DataFrame:
    rest = [c for c in lookup.columns if c != key]
    return lookup.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")


def _numbered(lookup: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows of a key: an update that meets several of them becomes as many rows."""
    rest = [c for c in lookup.columns if c != key]
    return lookup.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*rest)) - 1)


def delay_features(
    updates: DataFrame,
    trips: DataFrame,
    routes: DataFrame,
    vehicles: DataFrame,
    keep: Sequence[str] = (),
    unique_lookup: bool = False,
    row: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Twelve features and the label per update, plus ``row_id`` and the ``keep`` columns.

    A missing trip id is the text '' on the update and vehicle side, so such updates
    match such vehicles. Duplicate trip or route keys multiply updates unless
    ``unique_lookup`` is set. ``row`` names a unique, never null column of the updates;
    without one the updates are materialised and numbered. ``row_id`` joins it with the
    numbers of the trip and route rows met, so it is unique as well. The blank trip and
    route keys are salted; other hot keys are split by adaptive execution, see ``salted_left_join``.
    """
    if row is None:
        row = "row_number"
        while row in updates.columns:
            row = f"_{row}"
        updates = with_row_number(updates, row)
    seconds = number(updates, LABEL)
    facts = calendar_features(
        updates.select(
            *keep,
            F.col(row).alias("update_row"),
            F.coalesce(_text_or(updates, "feed", "Unknown"), F.lit("Unknown")).alias("feed"),
            F.coalesce(_text_or(updates, "trip_id", ""), F.lit("")).alias("trip_id"),
            parse_timestamp(updates, "timestamp" if "timestamp" in updates.columns else None).alias("timestamp"),
            seconds.alias(LABEL),
        ).filter(F.col(LABEL).isNotNull())
    ).drop("timestamp")
    lookups = [_trip_lookup(trips, unique_lookup), trip_vehicle_features(vehicles)]
    joined = salted_left_join(facts, lookups, "trip_id", F.col("update_row"), salts)
    joined = joined.withColumn("route_id", F.coalesce("route_id", F.lit("")))
    routed = salted_left_join(joined, [_route_lookup(routes, unique_lookup)], "route_id", F.col("update_row"), salts)
    missing = {
        "route_type": label(F.col("route_type")),
        "route_short_name": label(F.col("route_short_name")),
        "vehicle_status_mode": F.coalesce("vehicle_status_mode", F.lit("UNKNOWN")),
    }
    missing |= {c: F.coalesce(c, F.lit(0)) for c in ("direction_id", "has_vehicle_position", "vehicle_records")}
    copies = [F.coalesce(c, F.lit(0)).cast("string") for c in ("trip_copy", "route_copy")]
    row_id = F.concat_ws("-", F.col("update_row").cast("string"), *copies).alias("row_id")
    own = [c for c in keep if c != "row_id"]
    return routed.select(*own, row_id, *[missing.get(c, F.col(c)).alias(c) for c in FEATURES], LABEL)


def training_guards(features: DataFrame) -> DataFrame:
    """Row count, distinct labels and whether a model may be trained."""
    rows, labels = F.count(F.lit(1)), F.count_distinct(LABEL)
    return features.agg(rows.alias("n_rows"), labels.alias("n_labels")).withColumn(
        "trainable", (F.col("n_rows") >= MIN_ROWS) & (F.col("n_labels") > 1)
    )
