"""Left joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Salts of the blank key.
SALTS = 64


def blank_salt(key: str, row: Column, salts: int = SALTS) -> Column:
    """A salt by ``row``, a unique value, for rows whose key is blank or null; 0 for all others."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return F.when(blank, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salt_lookup(lookup: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """``lookup`` with its rows of the blank key once per salt."""
    every = F.when(F.col(key) == "", F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return lookup.withColumn("salt", F.explode(every))


def salted_left_join(
    fact: DataFrame, lookups: Sequence[DataFrame], key: str, row: Column, salts: int = SALTS
) -> DataFrame:
    """Left join ``fact`` with each lookup on ``key``.

    Missing ids all carry the blank key, which is therefore always salted. Other hot keys are split by adaptive
    execution, which it does only for joins whose two sides are shuffled for that join and nothing else: each join
    gets a key of its own, computed anew, so that none rests on the shuffle of the one before. ``row`` is unique per row
    of ``fact``. Lookups are not deduplicated: a key they hold twice doubles the matching rows.
    """
    out = fact.withColumn("salt", blank_salt(key, row, salts))
    own = "join_key"
    while own in fact.columns:
        own = f"_{own}"
    for lookup in lookups:
        salted = salt_lookup(lookup, key, salts).withColumnRenamed(key, own)
        out = out.withColumn(own, F.concat(F.col(key), F.lit(""))).join(salted, [own, "salt"], "left").drop(own)
    return out.drop("salt")
