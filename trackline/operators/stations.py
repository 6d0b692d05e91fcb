"""Station dimension: union of lists and deterministic first-copy dedupe."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trackline import schemas
from trackline.functions import strip

# What makes two stations copies of each other, and the lists the master is made of.
MASTER_KEY = ["station_code", "station_name", "lat", "lon", "source"]
LIST_KEY = ["station_code", "lat", "lon", "source"]
MASTER_LISTS = ("stations", "avld", "feve", "cercanias_madrid")


def first_copies(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union ``frames`` and keep, per key, the copy from the earliest frame.

    Copies inside one frame are ordered by the remaining columns, nulls last. A plain
    minimum, so every task reduces its copies before the shuffle and a key with very
    many copies never gathers in one task.
    """
    columns = frames[0].columns
    rest = [c for c in columns if c not in key]
    tagged = [f.withColumn("list_no", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = [F.col("list_no")]
    for c in rest:
        order += [F.col(c).isNull().alias(f"{c}_missing"), F.col(c)]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("best"))
    return best.select(*[F.col(c) if c in key else F.col(f"best.{c}").alias(c) for c in columns])


def station_master(bundle: dict[str, DataFrame], lists: Sequence[str] = MASTER_LISTS) -> DataFrame:
    """All station lists as one dimension: codes and names trimmed, points only, no copies."""
    present = [bundle[name].to(schemas.STATIONS) for name in lists if name in bundle]
    if not present:
        raise ValueError("no station list in the bundle")
    trimmed = {c: strip(F.col(c)) for c in ("station_code", "station_name")}
    return first_copies([points.dropna(subset=["lat", "lon"]).withColumns(trimmed) for points in present], MASTER_KEY)


def concat_station_lists(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of normalised lists; copies share code, coordinates and source."""
    return first_copies(frames, LIST_KEY)
