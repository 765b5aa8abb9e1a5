"""Counts and null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(predicate: Column) -> Column:
    return F.count(F.when(predicate, 1))


def percent(part: Column | str, whole: Column | str, digits: int | None = None) -> Column:
    """``100 * part / whole`` as a double, NULL when ``whole`` is zero or NULL."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    value = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return value if digits is None else F.round(value, digits)


def rating_score(rating: Column | str) -> Column:
    """HIGH, MEDIUM, LOW as 3, 2, 1; anything else is NULL."""
    rating = F.col(rating) if isinstance(rating, str) else rating
    return F.when(rating == "HIGH", 3).when(rating == "MEDIUM", 2).when(rating == "LOW", 1)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
