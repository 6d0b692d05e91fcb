"""Text expressions and identifier rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Words that count as "yes" in accessibility columns.
UNANCHORED_YES = "si|yes|x|1"
STRICT_YES = r"^\s*(s[ií]|yes|x|1)\s*$"

# Whitespace that str.strip() removes and that occurs in delimited files.
_BLANKS = " \t\n\r\x0b\x0c\u00a0"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(_BLANKS))


def label(col: Column, missing: str = "Unknown") -> Column:
    """Group label: null and blank share one ``missing`` group."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(missing))


def is_yes(col: Column, pattern: str = UNANCHORED_YES) -> Column:
    """True when the lower-cased text matches; null counts as no."""
    return F.coalesce(F.lower(col).rlike(pattern), F.lit(False))


def sanitize_name(value: str) -> str:
    """Table or column identifier: lower case, one ``_`` per run of other characters."""
    name = re.sub("[^a-z0-9]+", "_", value.lower()).strip("_") or "dataset"
    return f"t_{name}" if name[0].isdigit() else name


def sanitize_names(names: list[str]) -> list[str]:
    """Sanitise a header; repeats get ``_1``, ``_2``, ... and never collide."""
    out: list[str] = []
    for base in map(sanitize_name, names):
        repeats = 0
        name = base
        while name in out:
            repeats += 1
            name = f"{base}_{repeats}"
        out.append(name)
    return out


def sanitized(col: Column) -> Column:
    """``sanitize_name`` as an expression, for names that are data."""
    name = F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(name, "^$", "dataset"), "^([0-9])", "t_$1")
