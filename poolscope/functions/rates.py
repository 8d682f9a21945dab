"""Rate arithmetic shared by the state, indicator and attribution operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utilization(supply: Column, borrow: Column) -> Column:
    """Borrow over supply clipped to [0, 1]; 0 where nothing is supplied."""
    share = borrow.cast("double") / supply.cast("double")
    return F.when(supply > 0, F.greatest(F.lit(0.0), F.least(share, F.lit(1.0)))).otherwise(F.lit(0.0))


def annual_yield(rate: Column, seconds_per_year: int) -> Column:
    """Continuously compounded yearly yield of a per-second rate."""
    return F.expm1(rate * F.lit(float(seconds_per_year)))


def ratio_or(num: Column, den: Column, eps: float, default: float | None) -> Column:
    """``num / den`` where ``abs(den) > eps``, else ``default`` (null when None)."""
    return F.when(F.abs(den) > F.lit(eps), num / den).otherwise(
        F.lit(default).cast("double")
    )
