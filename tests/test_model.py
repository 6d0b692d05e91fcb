"""Feature table, training, evaluation and importance."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trackline.operators import features, forest, forest_parts
from trackline.operators.permutation import permutation_importance
from workload import model as model_queries


def frames(spark):
    updates = spark.createDataFrame(
        [
            ("a", "1", 60.0, dt.datetime(2024, 1, 6, 18)),
            (None, None, 30.0, None),
            ("b", "9", None, None),
            ("b", "2", 0.0, dt.datetime(2024, 1, 1, 5)),
        ],
        "feed string, trip_id string, delay_seconds double, timestamp timestamp",
    )
    trips = spark.createDataFrame([("1", "r1", "1"), ("1", "r1", "0"), ("2", "rX", None)], "trip_id string, route_id string, direction_id string")
    routes = spark.createDataFrame([("r1", None, "2")], "route_id string, route_short_name string, route_type string")
    vehicles = spark.createDataFrame([("1", "S"), (None, "T"), ("", "T")], "trip_id string, status string")
    return updates, trips, routes, vehicles


def test_feature_table(spark):
    table = features.delay_features(*frames(spark))
    assert table.columns == ["row_id", *features.FEATURES, features.LABEL]
    assert len({r.row_id for r in table.collect()}) == 4
    rows = [tuple(r) for r in table.drop("row_id").orderBy("delay_seconds", "direction_id").collect()]
    assert rows == [
        ("b", 0, 5, 0, 1, "night", "Unknown", "Unknown", 0, 0, "UNKNOWN", 0, 0.0),
        # A blank trip id matches vehicles with a blank trip id.
        ("Unknown", 0, 0, 0, 1, "night", "Unknown", "Unknown", 0, 1, "T", 2, 30.0),
        ("a", 5, 18, 1, 1, "evening", "2", "Unknown", 0, 1, "S", 1, 60.0),
        ("a", 5, 18, 1, 1, "evening", "2", "Unknown", 1, 1, "S", 1, 60.0),
    ]
    assert features.delay_features(*frames(spark), unique_lookup=True).count() == 3


def test_feature_table_without_optional_columns(spark):
    updates = spark.createDataFrame([("60",)], "delay_seconds string")
    other = spark.createDataFrame([("x",)], "other string")
    rows = [tuple(r) for r in features.delay_features(updates, other, other, other).drop("row_id").collect()]
    assert rows == [("Unknown", 0, 0, 0, 1, "night", "Unknown", "Unknown", 0, 0, "UNKNOWN", 0, 60.0)]


def test_guards(spark):
    table = features.delay_features(*frames(spark))
    assert tuple(features.training_guards(table).first()) == (4, 3, False)
    with pytest.raises(ValueError, match="cannot train"):
        forest.train(table, 2, 2)


def test_guards_look_at_the_whole_table(spark):
    columns = {c: F.lit("x") if c in features.CATEGORICAL else F.lit(1) for c in features.FEATURES}
    rows = spark.range(30).withColumnsRenamed({"id": "row_id"}).withColumns({**columns, "delay_seconds": F.rand(1)})
    train, _ = forest.split(forest.model_rows(rows))
    assert train.count() < 30
    with pytest.raises(ValueError, match="cannot train"):
        forest.train(train, 2, 2)
    assert forest.train(train, 2, 2, guarded=rows).forest.getNumTrees == 2


def test_rows_without_any_id_split_and_spread(spark):
    updates = spark.createDataFrame([(None, None, float(i % 7)) for i in range(600)], "entity_id string, trip_id string, delay_seconds double")
    none = spark.createDataFrame([], "trip_id string, route_id string")
    rows = forest.model_rows(features.delay_features(updates, none, none, none, keep=["entity_id"]))
    train, test = forest.split(rows)
    assert {r.row_id for r in rows.collect()} == {r.row_id for r in train.union(test).collect()} and rows.count() == 600
    assert 80 < test.count() < 160


@pytest.fixture(scope="module")
def planted(spark):
    """Delay depends on the hour alone; the other features are noise."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        hour = rng.randrange(24)
        rows.append(
            (i, rng.choice("ab"), rng.randrange(7), hour, 0, 1, rng.choice(["night", "evening"]), rng.choice(["2", "109"]),
             rng.choice(["C1", "C2", "C3"]), rng.randrange(2), rng.randrange(2), rng.choice(["S", "T"]), rng.randrange(4),
             hour * 100.0 + rng.random())
        )
    kinds = {c: "string" for c in features.CATEGORICAL}
    ddl = ", ".join(["row_id long"] + [f"{c} {kinds.get(c, 'int')}" for c in features.FEATURES] + ["delay_seconds double"])
    table = forest.model_rows(spark.createDataFrame(rows, ddl))
    train, test = forest.split(table)
    return table, train, test, forest.train(train, trees=10, depth=6)


def test_split_is_stable_and_complete(planted):
    table, train, test, _ = planted
    again = {r.row_id for r in forest.split(table.repartition(3))[0].collect()}
    ids = {r.row_id for r in train.collect()}
    assert ids == again
    assert train.count() + test.count() == table.count() == 1500
    assert 0.75 < train.count() / 1500 < 0.85


def test_metrics(spark, planted):
    _, _, test, model = planted
    metrics = forest.regression_metrics(forest.predict(model, test)).first()
    pairs = [(r.actual_delay_min, r.predicted_delay_min) for r in forest.actual_vs_predicted(forest.predict(model, test)).collect()]
    mean = sum(a for a, _ in pairs) / len(pairs)
    assert metrics.n_rows == len(pairs)
    assert metrics.mae_min == pytest.approx(sum(abs(a - p) for a, p in pairs) / len(pairs))
    assert metrics.r2 == pytest.approx(1 - sum((a - p) ** 2 for a, p in pairs) / sum((a - mean) ** 2 for a, _ in pairs))
    assert metrics.r2 > 0.9


def test_importance(spark, planted):
    model = planted[3]
    importance = forest.feature_importance(model, spark)
    rows = importance.collect()
    assert rows[0].feature == "num__hour"
    assert {"cat__feed_a", "cat__route_short_name_C3", "num__vehicle_records"} <= {r.feature for r in rows}
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    grouped = {r.group: r.importance for r in forest.grouped_importance(importance).collect()}
    assert set(grouped) == set(features.FEATURES)
    assert grouped["feed"] == pytest.approx(sum(r.importance for r in rows if r.group == "feed"))
    top = forest.top_importance(importance, 3).collect()
    assert [r.importance for r in top] == sorted(r.importance for r in rows[:3])


@pytest.mark.parametrize("block_rows", [10_000, 40])
def test_permutation_finds_the_signal(planted, block_rows):
    _, _, test, model = planted
    rows = permutation_importance(model, test, repeats=2, block_rows=block_rows).collect()
    assert rows[0].feature == "hour" and rows[0].importance > 0.5
    assert all(abs(r.importance) < 0.05 for r in rows if r.feature not in ("hour", "time_bucket"))
    assert {r.feature for r in rows} == set(features.FEATURES)


def test_donors_are_a_permutation(planted):
    from trackline.operators.permutation import _donor

    test = planted[2].withColumn("block", F.lit(0))
    pairs = test.select("row_id", F.struct("row_id", *features.FEATURES).alias("own"), _donor(0, 42).alias("donor"))
    own = sorted(str(r.own) for r in pairs.collect())
    donors = sorted(str(r.donor) for r in pairs.collect())
    assert own == donors


def test_score_handles_unseen_categories(spark, planted):
    record = spark.createDataFrame(
        [("new feed", "new type", "new name", 8, 5, 1, 0, 1, "new status", 1)],
        "feed string, route_type string, route_short_name string, hour int, day_of_week int, month int, "
        "direction_id int, has_vehicle_position int, vehicle_status_mode string, vehicle_records int",
    )
    scored = forest.score(planted[3], record).first()
    assert scored.time_bucket == "morning" and scored.is_weekend == 1
    assert scored.predicted_minutes == pytest.approx(scored.predicted_seconds / 60)
    assert 300 < scored.predicted_seconds < 1300


def learnable(spark, n=300):
    columns = {c: F.lit("x") for c in features.CATEGORICAL} | {c: F.lit(1) for c in features.NUMERIC}
    columns |= {"hour": (F.col("id") % 24).cast("int"), "feed": F.when(F.col("id") % 2 == 0, "even").otherwise("odd")}
    rows = spark.range(n).withColumn("row_id", F.col("id").cast("string")).withColumns(columns)
    return rows.withColumn("delay_seconds", F.col("hour") * 60.0 + F.when(F.col("feed") == "even", 600.0).otherwise(0.0))


def test_a_forest_in_parts_goes_on_where_it_stopped(spark, folder, monkeypatch):
    rows, fitted = learnable(spark), []
    real = forest_parts.RandomForestRegressor

    class Counting(real):
        def fit(self, *args):
            if len(fitted) == 2 and not stopped:
                stopped.append(True)
                raise RuntimeError("stopped")
            fitted.append((self.getNumTrees(), self.getSeed()))
            return super().fit(*args)

    stopped = []
    monkeypatch.setattr(forest_parts, "RandomForestRegressor", Counting)
    sizes = {"trees": 7, "depth": 4, "parts": 3}
    with pytest.raises(RuntimeError):
        forest_parts.train_parts(rows, f"{folder}/forest", **sizes)
    with pytest.raises(ValueError, match="not fitted yet"):
        forest_parts.load_parts(spark, f"{folder}/forest")
    model = forest_parts.train_parts(rows, f"{folder}/forest", **sizes)
    assert fitted == [(3, 42), (2, 43), (2, 44)]
    forest_parts.train_parts(rows, f"{folder}/forest", **sizes)
    assert len(fitted) == 3
    with pytest.raises(ValueError, match="other settings"):
        forest_parts.train_parts(rows, f"{folder}/forest", trees=8, depth=4, parts=3)

    # The mean over all trees, from the saved parts alone.
    again = forest_parts.load_parts(spark, f"{folder}/forest")
    whole = {r.row_id: r.predicted_seconds for r in forest.predict(again, rows).collect()}
    encoded = again.encoding.transform(rows)
    singles = [{r.row_id: r.predicted_seconds for r in p.transform(encoded).collect()} for p in again.parts]
    for key, value in whole.items():
        assert value == pytest.approx((3 * singles[0][key] + 2 * singles[1][key] + 2 * singles[2][key]) / 7)
    assert forest.regression_metrics(forest.predict(model, rows)).first().r2 > 0.9
    weights = forest.feature_importance(again, spark).collect()
    assert weights[0].feature == "num__hour" and sum(w.importance for w in weights) == pytest.approx(1)
    assert forest.score(again, rows.drop("time_bucket", "is_weekend")).count() == 300
    assert permutation_importance(again, rows).count() == len(features.FEATURES)


def test_new_records_are_spread_before_they_are_scored(spark, sf_dir):
    from workload import model

    sizes = model._new_records(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in sizes) < sum(r["count"] for r in sizes) / 4


def test_training_encodes_the_rows_once(spark, sf_dir):
    """The forest reads its rows three times before its first level; each of them encoded and split all rows anew."""
    rows, train, _ = model_queries._rows(spark, sf_dir)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(value):
        seen.add(1)
        return value

    n = train.count()
    fitted = forest.train(train.withColumn("month", counted("month")), trees=2, depth=3, guarded=rows)
    assert seen.value == n
    # The same forest as of a pipeline that ends with it.
    whole = forest.Pipeline(stages=[*forest.encoder().getStages(), fitted_like(2, 3)]).fit(train)
    assert fitted.forest.toDebugString.split("\n", 1)[1] == whole.stages[-1].toDebugString.split("\n", 1)[1]


def fitted_like(trees, depth):
    return forest.RandomForestRegressor(
        featuresCol="features", labelCol="delay_seconds", predictionCol="predicted_seconds", numTrees=trees, maxDepth=depth,
        seed=forest.SEED, maxMemoryInMB=1024, maxBins=64, featureSubsetStrategy="all",
    )
