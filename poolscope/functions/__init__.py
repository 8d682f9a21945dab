"""Column expressions: amount parsing and rate arithmetic."""

from poolscope.functions.amounts import base_units, rate_per_second
from poolscope.functions.rates import annual_yield, ratio_or, utilization

__all__ = ["annual_yield", "base_units", "rate_per_second", "ratio_or", "utilization"]
