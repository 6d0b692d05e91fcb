"""Null, blank, number, rounding and tie rules on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackline import schemas
from trackline.functions import (
    STRICT_YES,
    comma_double,
    delay_minutes,
    epoch_timestamp,
    is_yes,
    label,
    sanitize_name,
    sanitize_names,
    sanitized,
    speed_value,
    time_bucket,
    to_double,
    weekday,
)
from trackline.operators import counts, distributions, filters, normalize, rankings
from trackline.operators.columns import clean_columns, pick_column, preview
from trackline.operators.features import trip_vehicle_features
from trackline.operators.flatten import flatten_alerts, flatten_trip_updates, flatten_vehicles
from trackline.operators.stations import station_master

DELAYS = [-60.0, -30.0, 0.0, 300.0, 301.0, 1800.0, 600001.0, None]


def values(df):
    return [tuple(r) for r in df.collect()]


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i,) for i in items], f"x {kind}")


def apply(spark, items, fn, kind="string"):
    return [r[0] for r in column(spark, items, kind).select(fn(F.col("x"))).collect()]


def test_label_merges_null_and_blank(spark):
    assert apply(spark, ["", None, "a", " "], label) == ["Unknown", "Unknown", "a", " "]


def test_numbers(spark):
    texts = ["1,5", " 1.5 ", "1.5d", "inf", "nan", "", None, "-2e3", ".5", "3."]
    assert apply(spark, texts, to_double) == [None, 1.5, None, None, None, None, None, -2000.0, 0.5, 3.0]
    assert apply(spark, ["1,5", "x", "-0,25"], comma_double) == [1.5, None, -0.25]


def test_speed(spark):
    assert apply(spark, ["max 250,5 km/h", "n/d", "", None, "120"], speed_value) == [250.5, None, None, None, 120.0]


def test_rounding_is_half_even(spark):
    seconds = [3.0, 9.0, 15.0, 21.0]
    assert apply(spark, seconds, lambda c: delay_minutes(c, 1), "double") == [0.0, 0.2, 0.2, 0.4]


def test_calendar(spark):
    # 2024-01-01 is a Monday.
    stamps = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 7), None]
    assert apply(spark, stamps, weekday, "timestamp") == [0, 6, 0]
    hours = [0, 5, 6, 11, 12, 17, 18, 23]
    parts = ["night", "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]
    assert apply(spark, hours, time_bucket, "int") == parts
    assert apply(spark, ["0", "x", None], lambda c: F.unix_seconds(epoch_timestamp(c))) == [0, None, None]


def test_yes_words(spark):
    texts = ["SI", "sin", "sí", "X", "no", None, "21"]
    assert apply(spark, texts, is_yes) == [True, True, False, True, False, False, True]
    assert apply(spark, texts, lambda c: is_yes(c, STRICT_YES)) == [True, False, True, True, False, False, False]


def test_names(spark):
    raw = ["Código", "Descripción", "Andén", "Vestíbulo", "2x", "a", "a", "a_1", "  ", "CODIGO"]
    assert sanitize_names(raw) == [
        "c_digo", "descripci_n", "and_n", "vest_bulo", "t_2x", "a", "a_1", "a_1_1", "dataset", "codigo",
    ]
    texts = ["Código", "2024 list", "--", "a__b", "X"]
    assert apply(spark, texts, sanitized) == [sanitize_name(t) for t in texts]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["﻿CODIGO ", "Lat"])
    assert clean_columns(df).columns == ["CODIGO", "Lat"]
    assert pick_column(df, ["latitude", "LAT"]) == "Lat"
    assert pick_column(df, ["lon"]) is None
    assert preview(df, ["lat", "zzz"], 1).columns == ["Lat"]
    assert preview(df, ["zzz"], 1).columns == df.columns


def test_normalised_updates(spark):
    raw = spark.createDataFrame(
        [("t1", "2", "2024-01-01 10:00:00"), ("t2", "x", None), (None, "0.5", "soon")], "Id string, DELAY_MIN string, ts string"
    )
    assert values(normalize.normalize_trip_updates(raw).select("feed", "entity_id", "trip_id", "delay_seconds", "timestamp")) == [
        ("Warehouse", None, "t1", 120.0, dt.datetime(2024, 1, 1, 10)),
        ("Warehouse", None, None, 30.0, None),
    ]
    no_delay = normalize.normalize_trip_updates(raw.drop("DELAY_MIN"))
    assert no_delay.schema == schemas.TRIP_UPDATES and no_delay.count() == 0


def test_normalised_points_without_coordinates_are_empty(spark):
    raw = spark.createDataFrame([("a", "1")], "code string, lat string")
    assert normalize.normalize_geo_points(raw).count() == 0
    assert normalize.normalize_vehicles(raw).schema == schemas.VEHICLES


def test_normalised_defaults(spark):
    raw = spark.createDataFrame([("k",)], "anything string")
    assert values(normalize.normalize_scheduled_trips(raw)) == [("k", "", 0)]
    assert values(normalize.normalize_routes(raw)) == [("", "Unknown", "Unknown")]
    assert values(normalize.normalize_alerts(raw)) == [("", 0, "")]


def test_station_csv_drops_missing_and_zero(spark):
    raw = spark.createDataFrame(
        [(" 1 ", "A ", "40,5", "-3,5", "M"), ("2", "B", "0", "1", "M"), ("3", "C", "x", "1", "M")],
        ["CÓDIGO", "Descripcion", "LATITUD", "LONGITUD", "Provincia"],
    )
    assert values(normalize.normalize_station_csv(raw, "General")) == [("1", "A", 40.5, -3.5, "M", "General")]
    assert normalize.normalize_station_csv(raw, "General", drop_zero=False).count() == 2


TRIPS = """{"header": {"timestamp": "1704103200"}, "entity": [
 {"id": "own", "tripUpdate": {"trip": {"tripId": "1"}, "delay": 5, "stopTimeUpdate": [{"arrival": {"delay": 9}}]}},
 {"id": "arr", "tripUpdate": {"trip": {"tripId": "2"}, "stopTimeUpdate": [{"arrival": {"delay": 9}, "departure": {"delay": 7}}]}},
 {"id": "dep", "tripUpdate": {"trip": {"tripId": "3"}, "stopTimeUpdate": [{"departure": {"delay": 7}}]}},
 {"id": "none", "tripUpdate": {"trip": {"tripId": "4"}, "stopTimeUpdate": []}},
 {"id": "bare"}]}"""


def feed(spark, text, schema):
    return spark.createDataFrame([(text,)], "v string").select(F.from_json("v", schema).alias("d")).select("d.*")


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("plain", [5.0, 0.0, 0.0, 0.0, 0.0]),
        ("arrival", [5.0, 9.0, 0.0, 0.0, 0.0]),
        ("departure", [5.0, 9.0, 7.0, None, None]),
    ],
)
def test_delay_modes(spark, mode, expected):
    rows = flatten_trip_updates(feed(spark, TRIPS, schemas.TRIP_FEED), "f", mode).collect()
    assert [r.delay_seconds for r in rows] == expected
    assert {r.timestamp for r in rows} == {dt.datetime(2024, 1, 1, 10)}


def test_documents_without_entities(spark):
    empty = feed(spark, '{"header": {"timestamp": "x"}, "entity": []}', schemas.TRIP_FEED)
    assert values(flatten_trip_updates(empty, "f")) == [("f", None, None, 0.0, None)]
    assert flatten_trip_updates(empty, "f", keep_empty=False).count() == 0
    assert flatten_vehicles(feed(spark, "{}", schemas.VEHICLE_FEED), drop_null_coords=True).count() == 0


def test_alert_counts_and_text(spark):
    text = """{"entity": [{"id": "a", "alert": {"informedEntity": [{"routeId": "1"}, {}],
      "descriptionText": {"translation": [{"text": "es"}, {"text": "en"}]}}}, {"id": "b", "alert": {}}]}"""
    alerts = feed(spark, text, schemas.ALERT_FEED)
    assert values(flatten_alerts(alerts)) == [("a", 2, "es"), ("b", 0, None)]
    assert values(flatten_alerts(alerts, missing_text=""))[1] == ("b", 0, "")


def test_severity_edges(spark):
    updates = spark.createDataFrame([(d,) for d in DELAYS], "delay_seconds double")
    mix = {r.severity: r.trips for r in distributions.severity_mix(updates).collect()}
    # -60 s is on the open end, 600001 s above the last edge; null counts as 0.
    assert mix == {"On time": 3, "0-5 min": 1, "5-15 min": 1, "15-30 min": 1, "30+ min": 0}


def test_hourly_mean_rounds_first(spark):
    updates = spark.createDataFrame(
        [(0.2, None), (0.4, None), (60.0, dt.datetime(2024, 1, 1, 8))], "delay_seconds double, timestamp timestamp"
    )
    assert values(distributions.delay_by_hour(updates)) == [(-1, pytest.approx(0.005)), (8, 1.0)]


def test_histogram_edges(spark):
    assert values(distributions.histogram(column(spark, [2.0, 2.0], "double"), "x", 5)) == [(0, 2.0, 2.0, 2)]
    bins = dict((r.bin, r.n) for r in distributions.histogram(column(spark, [0.0, 1.0, 9.9, 10.0, None], "double"), "x", 10).collect())
    assert bins == {0: 1, 1: 1, 9: 2}


def test_delay_kpis(spark):
    updates = spark.createDataFrame([(d,) for d in DELAYS], "delay_seconds double")
    late = [300.0, 301.0, 1800.0, 600001.0]
    assert values(counts.delay_kpis(updates)) == [(4, pytest.approx(sum(late) / 4 / 60))]
    assert values(counts.delay_kpis(updates.filter("delay_seconds < 0"))) == [(0, 0.0)]


def test_top_delays_put_missing_last(spark):
    updates = spark.createDataFrame(
        [("f", "b", 60.0, None), ("f", "a", 60.0, None), ("f", "c", None, None), ("f", "d", float("nan"), None), ("f", "e", 90.0, None)],
        "feed string, trip_id string, delay_seconds double, timestamp timestamp",
    )
    assert [r.trip_id for r in rankings.top_delayed_trips(updates, 4).collect()] == ["e", "a", "b", "c"]


def test_vehicle_mode_ties_and_gaps(spark):
    rows = [("1", "b"), ("1", "a"), ("1", None), ("1", None), ("1", None), ("2", None), (None, "z"), ("", "z")]
    vehicles = spark.createDataFrame(rows, "trip_id string, status string")
    got = {r.trip_id: (r.vehicle_status_mode, r.vehicle_records) for r in trip_vehicle_features(vehicles).collect()}
    assert got == {"1": ("a", 5), "2": ("UNKNOWN", 1), "": ("z", 2)}


def test_station_master_keeps_first_copy(spark):
    def lst(*rows):
        return spark.createDataFrame(list(rows), schemas.STATIONS)

    bundle = {
        "avld": lst((" 1", "A", 1.0, 2.0, "late list", "s")),
        "stations": lst(("1", "A ", 1.0, 2.0, None, "s"), ("1", "A", 1.0, 2.0, "p", "s"), ("2", "B", None, 1.0, "p", "s")),
    }
    assert values(station_master(bundle)) == [("1", "A", 1.0, 2.0, "p", "s")]


def test_filter_choices(spark):
    df = spark.createDataFrame([("a",), (None,)], "source string")
    assert filters.value_in(df, "source", []).count() == 2
    assert filters.map_layer(df, []).count() == 0
    assert filters.value_in(df, "source", ["a"]).count() == 1
    updates = spark.createDataFrame([(d,) for d in [-1.0, 0.0, 10800.0, 10801.0, None]], "delay_seconds double")
    assert [r[0] for r in filters.delay_between(updates).collect()] == [0.0, 10800.0]


def test_filters_on_two_lists_only(spark):
    row = [("1", "A", 1.0, 2.0, "X", "s")]
    names = ("stations", "avld", "feve", "cercanias_madrid")
    bundle = {n: spark.createDataFrame(row, schemas.STATIONS) for n in names}
    all_lists = filters.business_filters(bundle, provinces=["Y"])
    two = filters.business_filters(bundle, provinces=["Y"], two_lists_only=True)
    assert [all_lists[n].count() for n in names] == [0, 0, 0, 0]
    assert [two[n].count() for n in names] == [0, 0, 1, 1]


def test_shares_and_parents(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y"), ("b", "x")], "source string, province string")
    shares = counts.with_share(counts.group_count(df, F.col("source"), "source", "n", 1), "n")
    assert values(shares) == [("a", 4, 1.0)]
    parents = counts.source_totals(counts.stations_by_source_province(df, 2))
    assert sorted(values(parents)) == [("a", 4, 2)]
