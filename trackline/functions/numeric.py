"""Text-to-number rules and delay arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

# Plain decimal notation only: rejects '1.5d', 'inf' and 'nan', which a bare cast accepts.
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Fixed value: first number inside free text such as 'max 250,5 km/h'.
FIRST_NUMBER = r"(\d+[\.,]?\d*)"


def to_double(col: Column) -> Column:
    """Text to double, null when the text is not a number."""
    return F.when(col.rlike(DECIMAL), col.try_cast("double"))


def comma_double(col: Column) -> Column:
    """Text with a decimal comma to double."""
    return to_double(F.replace(col, F.lit(","), F.lit(".")))


def number(df: DataFrame, name: str) -> Column:
    """A column as double whatever its type; text is parsed, NaN becomes null."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, NumericType):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    return to_double(col.cast("string"))


def integer(df: DataFrame, name: str | None, default: int = 0) -> Column:
    """A column as int with a default for missing or unparsable values."""
    if name is None:
        return F.lit(default).cast("int")
    return F.coalesce(number(df, name).try_cast("int"), F.lit(default))


def speed_value(col: Column) -> Column:
    return comma_double(F.nullif(F.regexp_extract(col, FIRST_NUMBER, 1), F.lit("")))


def delay_minutes(seconds: Column, digits: int | None = None) -> Column:
    """Seconds to minutes; rounding is half-even."""
    minutes = seconds / F.lit(60.0)
    return minutes if digits is None else F.bround(minutes, digits)
