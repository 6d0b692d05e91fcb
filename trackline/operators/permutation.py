"""Permutation importance as one distributed pass.

Every repeat gives each test row a random other row as donor: rows are spread over
small random blocks, each block is put in a random order, and the next row in that
order is the donor. That is a permutation of each block, needs one shuffle for all
repeats and no join. Swapped rows exist only between the window and the partial sums,
so the features x repeats blow-up is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackline.operators.features import FEATURES, LABEL
from trackline.operators.forest import SEED, DelayModel, predict

# Expected rows per block, at every size.
BLOCK_ROWS = 500


def permutation_importance(
    model: DelayModel, test: DataFrame, repeats: int = 5, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean drop in R² per feature when its values are permuted, highest first.

    ``test`` must carry the unique ``row_id`` of the feature table.
    """
    rows = with_donors(test, repeats, seed, block_rows)
    swaps = [F.struct(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("repeat"))]
    swaps += [F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in FEATURES for r in range(repeats)]
    swapped = rows.withColumn("swap", F.explode(F.array(*swaps))).select(
        LABEL, "swap.feature", "swap.repeat", *[_swapped(f, repeats).alias(f) for f in FEATURES]
    )
    error = F.col(LABEL) - F.col("predicted_seconds")
    scored = (
        predict(model, swapped)
        .groupBy("feature", "repeat")
        .agg(F.sum(error * error).alias("sse"), (F.var_pop(LABEL) * F.count(F.lit(1))).alias("sst"))
    )
    # At most features x repeats + 1 rows are left; the one without a feature is the base.
    r2 = 1 - F.col("sse") / F.col("sst")
    base = F.max(F.when(F.col("feature").isNull(), r2)).over(W.partitionBy(F.lit(0)))
    return (
        scored.withColumn("drop", base - r2)
        .filter(F.col("feature").isNotNull())
        .groupBy("feature")
        .agg(F.avg("drop").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def with_donors(test: DataFrame, repeats: int = 5, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``test`` with its block and, per repeat, the id and features of the donor row."""
    blocks = max(1, -(-test.count() // block_rows))
    rows = test.withColumn("block", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(blocks)))
    return rows.withColumns({f"donor_{r}": _donor(r, seed) for r in range(repeats)})


def _donor(repeat: int, seed: int) -> Column:
    values = F.struct("row_id", *FEATURES)
    block = W.partitionBy("block").orderBy(F.xxhash64("row_id", F.lit(seed), F.lit(repeat)), "row_id")
    everything = block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.coalesce(F.lead(values).over(block), F.first(values).over(everything))


def _swapped(feature: str, repeats: int) -> Column:
    """The donor's value in rows that swap ``feature``, the row's own elsewhere."""
    donors = F.array(*[F.col(f"donor_{r}.{feature}") for r in range(repeats)])
    return F.when(F.col("swap.feature") == feature, F.get(donors, F.col("swap.repeat"))).otherwise(F.col(feature))
