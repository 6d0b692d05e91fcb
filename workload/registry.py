"""Query registry: a name, a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackline.session import require_settings
from workload.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL over the views of ``workload.views``."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(require_settings(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without a zone, as in the driver tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded floats: sums run in a different order in each engine."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_number(column: str) -> str:
    """Text to double under the engine's number rule."""
    pattern = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"CASE WHEN regexp_matches({column}, '{pattern}') THEN TRY_CAST(trim({column}) AS DOUBLE) END"


def sql_label(column: str, missing: str = "Unknown") -> str:
    return f"COALESCE(NULLIF({column}, ''), '{missing}')"
