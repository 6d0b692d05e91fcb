"""Operators built for skew, against brute force, and the plans they rest on."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from tests.conftest import SF_DIR
from trackline.operators import counts, distributions
from trackline.operators.joins import SALTS, blank_salt, salted_left_join
from trackline.operators.quantiles import box_statistics
from trackline.operators.stations import station_master
from trackline.plans.marts import filter_values
from workload import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("salts", [1, 7, 64])
def test_salted_join_equals_plain_join(spark, salts):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        "id",
    )
    # Key '' is held twice, some keys not at all.
    one = spark.createDataFrame([("", 1), ("", 2)] + [(str(i), i) for i in range(0, 40)], "k string, a int")
    two = spark.createDataFrame([(str(i), i) for i in range(20, 50)] + [("", -1), (None, 5)], "k string, b int")
    salted = salted_left_join(fact, [one, two], "k", F.col("id"), salts)
    plain = fact.join(one, "k", "left").join(two, "k", "left")
    assert sorted(map(str, salted.select("k", "id", "a", "b").collect())) == sorted(
        map(str, plain.select("k", "id", "a", "b").collect())
    )


def test_salts_split_the_blank_key(spark):
    fact = spark.range(64_000).select(F.when(F.col("id") % 2 == 0, "").alias("k"), "id")
    salted = fact.withColumn("salt", blank_salt("k", F.col("id")))
    per_salt = [r.n for r in salted.groupBy("salt").agg(F.count("*").alias("n")).collect()]
    assert len(per_salt) == SALTS and max(per_salt) < 1_200
    kept = salted.select("k", "salt").union(spark.createDataFrame([("x", 0)], "k string, salt int"))
    assert kept.filter("k = 'x' AND salt = 0").count() == 1


def test_both_lookups_split_a_hot_trip(spark):
    """One named trip holds half the rows: adaptive execution splits it in either join."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("trip_id"), "id", F.md5(F.col("id").cast("string")).alias("text"))
        keys = spark.range(5_000).select(F.when(F.col("id") == 0, "hot").otherwise((F.col("id") * 2 + 1).cast("string")).alias("trip_id"))
        joined = salted_left_join(fact, [keys.withColumn("a", F.lit(1)), keys.withColumn("b", F.lit(2))], "trip_id", F.col("id"))
        # The text makes the rows as large as real ones: equal rows would shrink to nothing in the shuffle.
        sums = joined.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("text"))
        found = sums.collect()[0]
        final = plan(sums).split("== Initial Plan")[0]
        assert final.count("skew=true") == 2
        assert (found.n, found.a, found.b) == (400_000, 204_999, 409_998)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("case", ["random", "tied", "single", "negative", "huge"])
def test_quantiles_against_numpy(spark, case):
    rng = random.Random(7)
    groups = {
        "random": lambda: [rng.uniform(-500, 5000) for _ in range(257)],
        "tied": lambda: [rng.choice([0.0, 1.0, 1.0, 60.0]) for _ in range(100)],
        "single": lambda: [3.5],
        "negative": lambda: [-float(i) for i in range(11)],
        "huge": lambda: [rng.choice([1e-9, 1e12, -1e12]) * rng.random() for _ in range(64)],
    }
    data = [(g, x) for g in ("a", "b") for x in groups[case]()]
    df = spark.createDataFrame(data, "g string, x double")
    for r in box_statistics(df, "g", "x").collect():
        xs = [x for g, x in data if g == r.g]
        q1, q2, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3))
        low, high = r.q1 - 1.5 * (r.q3 - r.q1), r.q3 + 1.5 * (r.q3 - r.q1)
        inside = [x for x in xs if low <= x <= high]
        assert (r.n, r.min, r.max) == (len(xs), min(xs), max(xs))
        assert (r.lower_fence, r.upper_fence, r.outliers) == (min(inside), max(inside), len(xs) - len(inside))
        assert r.median == pytest.approx(statistics.median(xs))


PARTITION_CASES = [
    "station_master",
    "top_delayed_trips",
    "stations_by_source_province",
    "trip_vehicle_features",
    "ml_feature_table_salted",
    "delay_box",
]


@pytest.mark.parametrize("name", PARTITION_CASES)
def test_same_result_for_any_partitioning(spark, name):
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = spark_entry.queries()[name](spark, SF_DIR).collect()
            results.append(sorted(map(str, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_box_statistics_scan_once(spark):
    df = spark_entry.queries()["delay_box"](spark, SF_DIR)
    df.collect()
    final = plan(df).split("== Initial Plan")[0]
    assert final.count("FileScan") == 1


def test_reports_scan_each_dataset_once(spark):
    """Filter lists and counts are one aggregate per dataset; a view over several tables counts each of its scans once."""
    data = views.bundle(spark, SF_DIR)
    scans = lambda df: plan(df).split("== Initial Plan")[0].count("FileScan")
    names = ("train_info", "trip_updates", "gtfs_routes", "vehicles")
    assert scans(filter_values(data)) == scans(station_master(data)) + sum(scans(data[n].select(F.count("*"))) for n in names)
    assert scans(counts.operations_kpis({**data, "gtfs_trips": spark.read.parquet(f"{SF_DIR}/orders.parquet").select(F.col("o_orderkey").alias("trip_id"))})) == sum(
        scans(data[n].select(F.count("*"))) for n in ("stations", "gtfs_routes", "trip_updates", "vehicles", "alerts", "incidents")
    ) + 1


def test_sketches_can_be_kept_and_merged(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000).cast("string").alias("k"))
    kept = counts.distinct_sketches(df, F.col("day"), {"keys": F.col("k")})
    assert kept.count() == 7
    late = counts.distinct_sketches(spark.range(1).select(F.lit(9).alias("day"), F.lit("new").alias("k")), F.col("day"), {"keys": F.col("k")})
    value = counts.merged_distinct_counts(kept.unionByName(late), ["keys"]).first().value
    assert abs(value - 20_001) < 600


def test_top_k_needs_no_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark_entry.queries()["top_delayed_trips"](spark, SF_DIR))


def test_scan_reads_only_used_columns(spark):
    text = plan(distributions.delay_by_hour(views.frame(spark, SF_DIR, "fx_updates")))
    assert "props" not in text and "user_id" not in text


def test_feed_filter_reaches_the_scan(spark):
    text = plan(spark_entry.queries()["business_filters_updates"](spark, SF_DIR))
    assert "In(event_type" in text


def test_flattening_prunes_nested_fields(spark, folder):
    path = f"{folder}/feed"
    views.trip_feed(spark, SF_DIR, "A").write.parquet(path)
    from trackline.operators.flatten import flatten_trip_updates

    flat = flatten_trip_updates(spark.read.parquet(path), "f", "plain").select("trip_id")
    schema = plan(flat).split("ReadSchema:")[1]
    assert "tripId" in schema and "stopTimeUpdate" not in schema and "header" not in schema


def test_windows_stay_within_groups(spark):
    text = plan(spark_entry.queries()["delay_box"](spark, SF_DIR))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("], [feed" in line.replace("#", " ") or "[feed#" in line for line in windows)
    assert "Window [" not in plan(spark_entry.queries()["station_master"](spark, SF_DIR))
