"""Plan-time column handling: alias resolution, header cleaning, previews."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def pick_column(df: DataFrame, options: Iterable[str]) -> str | None:
    """First option present in ``df``, ignoring case, with the spelling ``df`` uses."""
    by_lower = {name.lower(): name for name in df.columns}
    return next((by_lower[o.lower()] for o in options if o.lower() in by_lower), None)


def clean_columns(df: DataFrame) -> DataFrame:
    """Drop byte-order marks and surrounding blanks from column names."""
    return df.toDF(*[name.replace("\ufeff", "").strip() for name in df.columns])


def preview(df: DataFrame, columns: Iterable[str], n: int | None = None, order_by: Iterable[str] = ()) -> DataFrame:
    """The present ones of ``columns`` (all if none is), in a declared order, first ``n`` rows."""
    order = [F.col(f"`{name}`").asc_nulls_last() for name in order_by]
    kept = [name for name in (pick_column(df, [c]) for c in columns) if name]
    rows = df.orderBy(*order) if order else df
    rows = rows.select(*[F.col(f"`{name}`") for name in kept]) if kept else rows
    return rows if n is None else rows.limit(n)
