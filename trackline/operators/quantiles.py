"""Exact quantiles and box statistics per group without gathering a group.

Works on value frequencies, so repeated values cost one row. Values fall into
logarithmic buckets whose order follows the value order. Totals of ranges of buckets, then
of the buckets of a range, locate the buckets that matter: those holding a wanted rank and
those a whisker limit cuts. Only their values are looked at one by one, and no task sorts
more than the ranges of a group or the buckets of a range.
A bucket spans a 65,536th of a doubling, so even 10^12 distinct values between 0 and 1
leave it some 10^7 to sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Buckets per doubling of the magnitude.
RESOLUTION = 65_536
# Neighbouring buckets counted as one at first.
RANGE = 4_096


def _bucket(value: Column) -> Column:
    size = F.floor(F.log1p(F.abs(value)) / F.lit(0.6931471805599453) * RESOLUTION)
    return F.when(value < 0, -size - 1).otherwise(size)


def value_frequencies(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows (``freq``) per group and known value, with the value's bucket and range of buckets."""
    # The filter names what the joins below require, so all of them share one shuffle.
    rows = df.select(group, value).withColumn("bucket", _bucket(F.col(value)))
    rows = rows.withColumn("range", F.floor(F.col("bucket") / RANGE))
    known = F.col(value).isNotNull() & ~F.isnan(value)
    rows = rows.filter(F.col(group).isNotNull() & known & F.col("bucket").isNotNull() & F.col("range").isNotNull())
    return rows.groupBy(group, "range", "bucket", value).agg(F.count(F.lit(1)).alias("freq"))


def bucket_totals(freq: DataFrame, group: str, value: str) -> DataFrame:
    """Rows (``n``) and extremes (``lo``, ``hi``) per group and bucket."""
    return freq.groupBy(group, "range", "bucket").agg(
        F.sum("freq").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )


def exact_quantiles(
    freq: DataFrame, buckets: DataFrame, group: str, value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per group with a linearly interpolated quantile per entry of ``probs``.

    ``freq`` comes from ``value_frequencies`` and ``buckets`` from ``bucket_totals``.
    """
    # First among ranges of buckets, some thousand a group, then inside the ranges that hold a wanted rank.
    totals = buckets.groupBy(group, "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(group).orderBy("range"))
    total = F.sum("n").over(W.partitionBy(group))
    ranked = totals.select(group, "range", (upto - F.col("n")).alias("before"), upto.alias("upto"), total.alias("total"))
    wanted = (
        ranked.select(group, "range", "before", "upto", F.explode(_wanted_ranks(probs)).alias("w"))
        .filter((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("upto")))
        .select(group, "range", "before", "w.*")
    )
    inside = F.sum("n").over(W.partitionBy(group, "range", "name", "side").orderBy("bucket"))
    targets = (
        buckets.join(wanted, [group, "range"])
        .withColumn("upto", F.col("before") + inside)
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
        .select(group, "bucket", "before", "name", "side", "rank", "weight")
    )
    running = F.col("before") + F.sum("freq").over(W.partitionBy(group, "bucket", "name", "side").orderBy(value))
    hits = (
        freq.join(targets, [group, "bucket"])
        .withColumn("running", running)
        .filter(F.col("running") > F.col("rank"))
        .groupBy(group, "name", "side", "weight")
        .agg(F.min(value).alias("v"))
    )
    # The two neighbours of a rank are mixed by its fraction.
    return hits.groupBy(group).agg(
        *[F.sum(F.when(F.col("name") == name, F.col("v") * F.col("weight"))).alias(name) for name in probs]
    )


def _wanted_ranks(probs: dict[str, float]) -> Column:
    """Per quantile, the ranks below and above its position, with their weights."""
    entries = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("total") - 1)
        below, fraction = F.floor(position), position - F.floor(position)
        for side, rank, weight in ((0, below, F.lit(1.0) - fraction), (1, F.ceil(position), fraction)):
            entries.append(
                F.struct(
                    F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"), weight.alias("weight")
                )
            )
    return F.array(*entries)


def box_statistics(df: DataFrame, group: str, value: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quartiles, whisker ends at 1.5 IQR and outlier count per group."""
    names = dict(zip(("q1", "median", "q3"), probs))
    freq = value_frequencies(df, group, value)
    buckets = bucket_totals(freq, group, value)
    spread = F.col("q3") - F.col("q1")
    placed = buckets.join(exact_quantiles(freq, buckets, group, value, names), group).withColumns(
        {"low": F.col("q1") - 1.5 * spread, "high": F.col("q3") + 1.5 * spread}
    )
    lo, hi, low, high = F.col("lo"), F.col("hi"), F.col("low"), F.col("high")
    within = (lo >= low) & (hi <= high)
    beyond = (hi < low) | (lo > high)
    cut = ~(within | beyond)
    # Each limit runs through at most one bucket; all others count as a whole.
    whole = (
        placed.groupBy(group, *names, "low", "high")
        .agg(
            F.sum("n").alias("n"),
            F.min(lo).alias("min"),
            F.max(hi).alias("max"),
            F.min(F.when(within, lo)).alias("lower"),
            F.max(F.when(within, hi)).alias("upper"),
            F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outside"),
            F.max(F.when(cut & (lo < low), F.col("bucket"))).alias("cut_low"),
            F.max(F.when(cut & (hi > high), F.col("bucket"))).alias("cut_high"),
        )
        .withColumn("bucket", F.explode(F.array_distinct(F.array("cut_low", "cut_high"))))
        .drop("cut_low", "cut_high")
    )
    x, inside = F.col(value), F.col(value).between(low, high)
    kept = [group, *names, "n", "min", "max", "lower", "upper", "outside"]
    return (
        whole.join(freq, [group, "bucket"], "left")
        .groupBy(*kept)
        .agg(
            F.min(F.when(inside, x)).alias("cut_lower"),
            F.max(F.when(inside, x)).alias("cut_upper"),
            F.coalesce(F.sum(F.when(~inside, F.col("freq"))), F.lit(0)).alias("cut_outside"),
        )
        .select(
            group,
            *names,
            "n",
            "min",
            "max",
            F.least("lower", "cut_lower").alias("lower_fence"),
            F.greatest("upper", "cut_upper").alias("upper_fence"),
            (F.col("outside") + F.col("cut_outside")).alias("outliers"),
        )
    )


def approximate_box(df: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Quartiles, extremes and count per group from mergeable sketches; a quartile's rank is off by 1 / ``accuracy`` at most."""
    known = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    found = known.groupBy(group).agg(
        F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias("q"),
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = [F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    return found.select(group, *quartiles, "n", "min", "max")
