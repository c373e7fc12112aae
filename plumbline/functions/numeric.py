"""Scalar guards and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def safe_number(text: Column) -> Column:
    """Double from text; NULL when it does not parse or is not finite."""
    return finite(text.try_cast("double"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def logit_percent(score: Column, floor: float = 0.05) -> Column:
    """Log odds of a 0-100 score held inside [floor, 100 - floor]."""
    v = clamp(score, floor, 100.0 - floor)
    return F.ln(v / (100.0 - v))


def percent_from_logit(z: Column) -> Column:
    return 100.0 / (1.0 + F.exp(-clamp(z, -30.0, 30.0)))


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(365.25)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL when b is zero."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation; NULL when either side does not vary."""
    size = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(size > 0, size)
