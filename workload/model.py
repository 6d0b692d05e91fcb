"""Queries: feature table and delay model."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackline.operators import features, forest, forest_parts
from trackline.operators.permutation import permutation_importance, with_donors
from trackline.session import shared_dir
from workload import views
from workload.registry import query, rounded, sql_label

# Forest size of the registered queries. The full size of the library, 400 trees of depth 16, takes over 7
# minutes at sf0.01 on a shared machine with 8 cores (2 minutes at sf0.001), too long for every run of them.
TREES, DEPTH = 20, 8
# The fitted model per folder, kept as long as its session runs.
_FITTED: dict[tuple[str, str], tuple] = {}

MODE = """
    SELECT t.trip_id, CAST(1 AS INTEGER) AS has_vehicle_position, COALESCE(m.status, 'UNKNOWN') AS vehicle_status_mode,
           t.vehicle_records
    FROM (SELECT COALESCE(trip_id, '') AS trip_id, count(*) AS vehicle_records FROM fx_vehicles GROUP BY 1) t
    LEFT JOIN (SELECT trip_id, status FROM (
                 SELECT COALESCE(trip_id, '') AS trip_id, status,
                        row_number() OVER (PARTITION BY COALESCE(trip_id, '') ORDER BY count(*) DESC, status) AS pick
                 FROM fx_vehicles WHERE status IS NOT NULL GROUP BY COALESCE(trip_id, ''), status) s WHERE pick = 1) m
      ON m.trip_id = t.trip_id"""

NUMBERED = "SELECT *, CAST(entity_id AS BIGINT) AS row_no FROM fx_updates"

FEATURES = f"""
    SELECT u.entity_id, concat_ws('-', u.row_no, COALESCE(t.trip_copy, 0), COALESCE(r.route_copy, 0)) AS row_id, u.feed,
           CAST(COALESCE(isodow(u.timestamp) - 1, 0) AS INTEGER) AS day_of_week,
           CAST(COALESCE(hour(u.timestamp), 0) AS INTEGER) AS hour,
           CAST(CASE WHEN COALESCE(isodow(u.timestamp) - 1, 0) >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
           CAST(COALESCE(month(u.timestamp), 1) AS INTEGER) AS month,
           CASE WHEN COALESCE(hour(u.timestamp), 0) <= 5 THEN 'night' WHEN COALESCE(hour(u.timestamp), 0) <= 11 THEN 'morning'
                WHEN COALESCE(hour(u.timestamp), 0) <= 17 THEN 'afternoon' ELSE 'evening' END AS time_bucket,
           {sql_label("r.route_type")} AS route_type, {sql_label("r.route_short_name")} AS route_short_name,
           CAST(COALESCE(TRY_CAST(t.direction_id AS INTEGER), 0) AS INTEGER) AS direction_id,
           COALESCE(v.has_vehicle_position, 0) AS has_vehicle_position,
           COALESCE(v.vehicle_status_mode, 'UNKNOWN') AS vehicle_status_mode,
           COALESCE(v.vehicle_records, 0) AS vehicle_records, u.delay_seconds
    FROM (SELECT entity_id, row_no, COALESCE(feed, 'Unknown') AS feed, COALESCE(trip_id, '') AS trip_id, timestamp,
                 delay_seconds
          FROM ({NUMBERED}) n WHERE delay_seconds IS NOT NULL) u
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY route_id NULLS FIRST,
                 COALESCE(TRY_CAST(direction_id AS INTEGER), 0)) - 1 AS trip_copy FROM fx_trips) t ON t.trip_id = u.trip_id
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY route_type NULLS FIRST,
                 route_short_name NULLS FIRST) - 1 AS route_copy FROM fx_routes) r ON r.route_id = COALESCE(t.route_id, '')
    LEFT JOIN ({MODE}) v ON v.trip_id = u.trip_id"""


def numbered_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates with the number of their event, which tells them apart."""
    return views.frame(spark, sf_dir, "fx_updates").withColumn("row_no", F.col("entity_id").cast("long"))


def feature_table(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return features.delay_features(
        numbered_updates(spark, sf_dir),
        views.frame(spark, sf_dir, "fx_trips"),
        views.frame(spark, sf_dir, "fx_routes"),
        views.frame(spark, sf_dir, "fx_vehicles"),
        keep=["entity_id"],
        row="row_no",
        **options,
    )


@query("trip_vehicle_features", MODE)
def trip_vehicle_features(spark, sf_dir):
    return features.trip_vehicle_features(views.frame(spark, sf_dir, "fx_vehicles"))


@query("ml_feature_table", FEATURES)
def ml_feature_table(spark, sf_dir):
    return feature_table(spark, sf_dir)


@query("ml_feature_table_salted", FEATURES)
def ml_feature_table_salted(spark, sf_dir):
    """The same table, with the blank keys spread over many salts."""
    return feature_table(spark, sf_dir, salts=1_000)


@query(
    "ml_feature_table_unique",
    f"""SELECT u.entity_id, u.trip_id, t.direction_id FROM
          (SELECT entity_id, COALESCE(trip_id, '') AS trip_id FROM fx_updates WHERE delay_seconds IS NOT NULL) u
        JOIN (SELECT trip_id, min(CAST(COALESCE(TRY_CAST(direction_id AS INTEGER), 0) AS INTEGER)) AS direction_id
              FROM fx_trips GROUP BY trip_id) t USING (trip_id)""",
)
def ml_feature_table_unique(spark, sf_dir):
    """Directions when every scheduled trip counts once."""
    updates = views.frame(spark, sf_dir, "fx_updates")
    keyed = updates.withColumn("trip", F.coalesce("trip_id", F.lit("")))
    table = features.delay_features(
        keyed,
        views.frame(spark, sf_dir, "fx_trips"),
        views.frame(spark, sf_dir, "fx_routes"),
        views.frame(spark, sf_dir, "fx_vehicles"),
        keep=["entity_id", "trip"],
        unique_lookup=True,
    )
    known = views.frame(spark, sf_dir, "fx_trips").select(F.col("trip_id").alias("trip"))
    return table.join(known, "trip", "left_semi").select("entity_id", F.col("trip").alias("trip_id"), "direction_id")


@query(
    "ml_guards",
    f"""SELECT count(*) AS n_rows, count(DISTINCT delay_seconds) AS n_labels,
               count(*) >= 30 AND count(DISTINCT delay_seconds) > 1 AS trainable FROM ({FEATURES}) f""",
)
def ml_guards(spark, sf_dir):
    return features.training_guards(feature_table(spark, sf_dir))


@query(
    "regression_metrics",
    """SELECT count(*) AS n_rows, round(avg(abs(e)) / 60, 6) AS mae_min, round(sqrt(sum(e * e) / count(*)) / 60, 6) AS rmse_min,
              round(1 - sum(e * e) / (var_pop(delay_seconds) * count(*)), 6) AS r2
       FROM (SELECT delay_seconds, delay_seconds - p AS e FROM (
               SELECT delay_seconds, avg(delay_seconds) OVER (PARTITION BY feed, hour(timestamp)) AS p
               FROM fx_updates WHERE delay_seconds IS NOT NULL) a) b""",
)
def regression_metrics(spark, sf_dir):
    """Metrics of a baseline that predicts the mean of the feed and hour."""
    updates = views.frame(spark, sf_dir, "fx_updates").filter("delay_seconds is not null")
    keyed = updates.select("delay_seconds", "feed", F.hour("timestamp").alias("hour"))
    means = keyed.groupBy("feed", "hour").agg(F.avg("delay_seconds").alias("predicted_seconds"))
    same = (keyed["feed"] == means["feed"]) & keyed["hour"].eqNullSafe(means["hour"])
    predictions = keyed.join(means, same).select("delay_seconds", "predicted_seconds")
    return rounded(forest.regression_metrics(predictions), "mae_min", "rmse_min", "r2")


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The materialised feature table, its training and its test rows."""
    rows = forest.model_rows(feature_table(spark, sf_dir))
    return rows, *forest.split(rows)


def _trained(spark: SparkSession, sf_dir: str) -> tuple[forest.DelayModel, DataFrame, DataFrame]:
    """Model, training rows and test rows, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        for old in [k for k in _FITTED if k[0] != key[0]]:
            del _FITTED[old]
        rows, train, test = _rows(spark, sf_dir)
        _FITTED[key] = forest.train(train, trees=TREES, depth=DEPTH, guarded=rows), train, test
    return _FITTED[key]


SPLIT = f"""
    SELECT row_id, CASE WHEN CAST('0x' || substr(md5(concat(row_id, '/{forest.SEED}')), 1, 8) AS BIGINT) % 100
                          < {forest.TRAIN_PERCENT} THEN 'train' ELSE 'test' END AS part FROM ({FEATURES}) f"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = _rows(spark, sf_dir)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("ml_split_counts", f"SELECT part, count(*) AS n FROM ({SPLIT}) s GROUP BY part")
def ml_split_counts(spark, sf_dir):
    return _parts(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("ml_split_rows", SPLIT)
def ml_split_rows(spark, sf_dir):
    """Which side each row of the model is on; trips listed twice make rows of their own."""
    return _parts(spark, sf_dir).select("row_id", "part")


# Updates without any entity id, as warehouse results have them: rows are told apart by position alone.
BLANK_IDS = """
    SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_ids, count(*) AS with_id, 2 AS parts
    FROM (SELECT row_number() OVER () AS row_id FROM fx_updates u WHERE delay_seconds IS NOT NULL) s"""


@query("ml_split_blank_ids", BLANK_IDS)
def ml_split_blank_ids(spark, sf_dir):
    """A bundle from user SQL has no entity ids; its rows still get unique ids and two sides."""
    updates = views.frame(spark, sf_dir, "fx_updates").drop("entity_id", "trip_id")
    none = [views.frame(spark, sf_dir, v).limit(0) for v in ("fx_trips", "fx_routes", "fx_vehicles")]
    train, test = forest.split(forest.model_rows(features.delay_features(updates, *none)))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("row_id").alias("n_ids"),
        F.count("row_id").alias("with_id"),
        F.count_distinct("part").cast("int").alias("parts"),
    )


CODES = "\n UNION ALL ".join(
    f"""SELECT row_id, '{c}' AS feature, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code FROM ({FEATURES}) f"""
    for c in features.CATEGORICAL
)


@query("ml_encoded_features", CODES)
def ml_encoded_features(spark, sf_dir):
    """The index each category gets before it becomes a one-hot vector: its place in the alphabet."""
    rows, *_ = _rows(spark, sf_dir)
    encoded = forest.encoder().fit(rows).transform(rows)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_index").alias("code")) for c in features.CATEGORICAL]
    return encoded.select("row_id", F.explode(F.array(*pairs)).alias("p")).select("row_id", "p.*")


OFFSETS = "\n UNION ALL ".join(
    f"""SELECT {i} AS place, '{c}' AS feature, count(DISTINCT {c}) AS width FROM ({FEATURES}) f"""
    for i, c in enumerate(features.CATEGORICAL)
)
ONE_HOT = f"""
    SELECT row_id, c.feature, CAST(c.code AS BIGINT) + CAST(COALESCE(o.before, 0) AS BIGINT) AS hot, CAST(1 AS BIGINT) AS ones
    FROM ({CODES}) c JOIN (SELECT feature, sum(width) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                           FROM ({OFFSETS}) w) o USING (feature)"""


@query("ml_one_hot", ONE_HOT)
def ml_one_hot(spark, sf_dir):
    """Where in the feature vector each category of a row is set, and how many places of its block are."""
    rows, *_ = _rows(spark, sf_dir)
    encoding = forest.encoder().fit(rows)
    values, blocks, at = vector_to_array("features"), [], 0
    for column, labels in zip(features.CATEGORICAL, encoding.stages[0].labelsArray):
        block = F.slice(values, at + 1, len(labels))
        hot = F.array_position(block, F.lit(1.0)) - 1 + at
        ones = F.size(F.filter(block, lambda v: v != 0.0)).cast("long")
        blocks.append(F.struct(F.lit(column).alias("feature"), hot.alias("hot"), ones.alias("ones")))
        at += len(labels)
    return encoding.transform(rows).select("row_id", F.inline(F.array(*blocks)))


NAMES = "\n UNION ALL ".join(
    [f"""SELECT DISTINCT concat('cat__{c}_', {c}) AS feature, '{c}' AS "group" FROM ({FEATURES}) f JOIN ({SPLIT}) s USING (row_id)
         WHERE part = 'train'""" for c in features.CATEGORICAL]
    + [f"SELECT 'num__{c}', '{c}'" for c in features.NUMERIC]
)


@query("ml_importance_names", NAMES)
def ml_importance_names(spark, sf_dir):
    """The features that importances are given for, with their root variables."""
    return forest.feature_importance(_trained(spark, sf_dir)[0], spark).select("feature", "group")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as features of their segment, weighted by balance."""
    return views.frame(spark, sf_dir, "customer").select(
        F.col("c_name").alias("feature"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("importance")
    )


@query(
    "importance_top",
    """SELECT feature, importance FROM (SELECT c_name AS feature, c_acctbal AS importance FROM customer
         ORDER BY c_acctbal DESC, c_name LIMIT 20) t""",
)
def importance_top(spark, sf_dir):
    return forest.top_importance(_weighted(spark, sf_dir), 20).select("feature", "importance")


@query("importance_by_root", """SELECT c_mktsegment AS "group", round(sum(c_acctbal), 4) AS importance FROM customer GROUP BY 1""")
def importance_by_root(spark, sf_dir):
    return rounded(forest.grouped_importance(_weighted(spark, sf_dir)), "importance", digits=4)


@query("ml_parts_rows", f"""SELECT row_id, CAST(1 AS INTEGER) AS predicted, true AS mean FROM ({SPLIT}) s WHERE part = 'test'""")
def ml_parts_rows(spark, sf_dir):
    """A forest fitted in saved parts and loaded again: each test row gets the mean over the trees of all parts."""
    rows, train, test = _rows(spark, sf_dir)
    folder = shared_dir(spark, f"forest-{uuid.uuid4().hex}")
    forest_parts.train_parts(train, folder, trees=6, depth=DEPTH, parts=3, guarded=rows)
    model = forest_parts.load_parts(spark, folder)
    out = model.encoding.transform(forest.predict(model, test))
    for i, part in enumerate(model.parts):
        out = part.copy().setPredictionCol(f"single_{i}").transform(out)
    single = sum(F.col(f"single_{i}") for i in range(len(model.parts))) / len(model.parts)
    close = F.abs(F.col("predicted_seconds") - single) < 1e-6
    return out.select("row_id", F.col("predicted_seconds").isNotNull().cast("int").alias("predicted"), close.alias("mean"))


DONORS = f"""
    SELECT r.repeat, count(*) AS n_rows, count(DISTINCT row_id) AS n_rows_once, count(DISTINCT row_id) AS n_donors_once,
           0 AS n_foreign
    FROM (SELECT row_id FROM ({SPLIT}) s WHERE part = 'test') t, (SELECT unnest([0, 1, 2]) AS repeat) r GROUP BY r.repeat"""


@query("ml_permutation_donors", DONORS)
def ml_permutation_donors(spark, sf_dir):
    """Per repeat every test row is a donor once, and to a row of its own block."""
    _, _, test = _rows(spark, sf_dir)
    donors = with_donors(test, repeats=3)
    blocks = donors.select(F.col("row_id").alias("donor"), F.col("block").alias("donor_block"))
    pairs = [F.struct(F.lit(r).alias("repeat"), F.col(f"donor_{r}.row_id").alias("donor")) for r in range(3)]
    met = donors.select("row_id", "block", F.explode(F.array(*pairs)).alias("p")).select("row_id", "block", "p.*")
    return met.join(blocks, "donor").groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("row_id").alias("n_rows_once"),
        F.count_distinct("donor").alias("n_donors_once"),
        F.count_if(F.col("block") != F.col("donor_block")).cast("int").alias("n_foreign"),
    )


@query("ml_metrics")
def ml_metrics(spark, sf_dir):
    model, _, test = _trained(spark, sf_dir)
    return forest.regression_metrics(forest.predict(model, test))


@query("ml_importance_sums", "SELECT CAST(1.0 AS DOUBLE) AS total, CAST(12 AS BIGINT) AS n_groups, CAST(0.0 AS DOUBLE) AS gap")
def ml_importance_sums(spark, sf_dir):
    """Importances sum to one, and a group's importance is the sum of its parts."""
    parts = forest.feature_importance(_trained(spark, sf_dir)[0], spark)
    sums = parts.groupBy("group").agg(F.sum("importance").alias("of_parts"))
    both = forest.grouped_importance(parts).join(sums, "group")
    return rounded(
        both.agg(
            F.sum("of_parts").alias("total"),
            F.count(F.lit(1)).alias("n_groups"),
            F.max(F.abs(F.col("importance") - F.col("of_parts"))).alias("gap"),
        ),
        "total",
        "gap",
    )


@query("ml_importance")
def ml_importance(spark, sf_dir):
    return forest.top_importance(forest.feature_importance(_trained(spark, sf_dir)[0], spark), 20)


@query("ml_importance_grouped")
def ml_importance_grouped(spark, sf_dir):
    grouped = forest.grouped_importance(forest.feature_importance(_trained(spark, sf_dir)[0], spark))
    return forest.top_importance(grouped, 12)


@query("ml_permutation")
def ml_permutation(spark, sf_dir):
    model, _, test = _trained(spark, sf_dir)
    return permutation_importance(model, test)


@query("ml_actual_vs_predicted")
def ml_actual_vs_predicted(spark, sf_dir):
    model, _, test = _trained(spark, sf_dir)
    return forest.actual_vs_predicted(forest.predict(model, test))


@query(
    "ml_actual_values",
    f"""SELECT round(delay_seconds / 60, 6) AS actual_delay_min, CAST(1 AS INTEGER) AS predicted
        FROM ({FEATURES}) f JOIN ({SPLIT}) s USING (row_id) WHERE part = 'test'""",
)
def ml_actual_values(spark, sf_dir):
    """The actual side of the comparison: every test row once, each with a prediction."""
    model, _, test = _trained(spark, sf_dir)
    pairs = forest.actual_vs_predicted(forest.predict(model, test))
    return rounded(pairs, "actual_delay_min").select(
        "actual_delay_min", F.col("predicted_delay_min").isNotNull().cast("int").alias("predicted")
    )


@query(
    "ml_score_keys",
    """SELECT route_id, CAST(h.hour AS INTEGER) AS hour,
              CASE WHEN h.hour <= 5 THEN 'night' WHEN h.hour <= 11 THEN 'morning' WHEN h.hour <= 17 THEN 'afternoon'
                   ELSE 'evening' END AS time_bucket,
              CAST(0 AS INTEGER) AS is_weekend, CAST(0.0 AS DOUBLE) AS minutes_off
       FROM fx_routes, (SELECT unnest(range(0, 24)) AS hour) h""",
)
def ml_score_keys(spark, sf_dir):
    """Keys and derived columns of the scored records, and the minutes against the seconds."""
    scored = forest.score(_trained(spark, sf_dir)[0], _new_records(spark, sf_dir))
    off = F.round(F.col("predicted_minutes") * 60 - F.col("predicted_seconds"), 6) + 0.0
    return scored.select("route_id", "hour", "time_bucket", "is_weekend", off.alias("minutes_off"))


@query("ml_score_new")
def ml_score_new(spark, sf_dir):
    """Scores for every known route at every hour of a Monday."""
    scored = forest.score(_trained(spark, sf_dir)[0], _new_records(spark, sf_dir))
    return scored.select("route_id", "hour", "predicted_seconds", "predicted_minutes")


def _new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = views.frame(spark, sf_dir, "fx_routes")
    # The routes are few bytes and lie in one part or two; scoring their records is work for all cores.
    spread = routes.repartition(4 * spark.sparkContext.defaultParallelism, "route_id")
    return spread.select(
        "route_id",
        F.lit("click").alias("feed"),
        F.coalesce("route_type", F.lit("Unknown")).alias("route_type"),
        F.coalesce("route_short_name", F.lit("Unknown")).alias("route_short_name"),
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"),
        F.lit(0).alias("day_of_week"),
        F.lit(1).alias("month"),
        F.lit(0).alias("direction_id"),
        F.lit(1).alias("has_vehicle_position"),
        F.lit("STOPPED_AT").alias("vehicle_status_mode"),
        F.lit(1).alias("vehicle_records"),
    )
