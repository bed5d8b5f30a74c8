"""Column expressions whose results agree between engines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x: Column | str, digits: int) -> Column:
    """Round by scaling, as binary engines do; Spark's own round goes through decimals."""
    scale = float(10**digits)
    return F.round(col(x) * scale) / scale


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as doubles, null when whole is 0 or null."""
    return col(part).cast("double") / F.nullif(col(whole).cast("double"), F.lit(0.0))


def blank_to_null(x: Column | str) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(col(x)), F.lit(""))


def is_blank(x: Column | str) -> Column:
    """True for null and for text of spaces only."""
    return col(x).isNull() | (F.trim(col(x)) == "")


def is_finite(x: Column | str) -> Column:
    return ~F.isnan(col(x)) & (F.abs(col(x)) < float("inf"))


def safe_date(x: Column | str) -> Column:
    """Date in the first ten characters, null unless they are a whole calendar date."""
    head = F.left(col(x), F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def cell(x: Column | str, size: float) -> Column:
    return F.floor(col(x) / size).cast("int")


def joined(*parts: Column | str) -> Column:
    """Text of all parts together; nulls are skipped."""
    return F.concat_ws("", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lookup(x: Column | str, names: Mapping[str, str]) -> Column:
    """Name of a value, the value itself where it has none."""
    out = col(x)
    for value, name in names.items():
        out = F.when(col(x) == value, name).otherwise(out)
    return out


def outside(x: Column | str, low: float, high: float) -> Column:
    return (col(x) < low) | (col(x) > high)
