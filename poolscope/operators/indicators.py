"""Rolling market indicators: level statistics, flow intensities, elasticity, regime flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.functions import ratio_or
from poolscope.operators.ordered import CELL
from poolscope.operators.rolling import Measures, Output, Window, rolling
from poolscope.operators.state import PREVIOUS, with_previous
from poolscope.schemas import (
    INDICATOR_WINDOWS, LEDGER, SECONDS_PER_YEAR, amount_type_of, indicator_schema, with_amounts,
)

# Flow behind each intensity.
_INTENSITIES = {
    "borrow": "borrow_in_assets",
    "repay": "borrow_out_assets",
    "supply": "supply_in_assets",
    "withdraw": "supply_out_assets",
}
# Utilization levels, in percent, above which a regime flag is set.
_REGIMES = (90, 95, 99)


def has_previous(ledger: DataFrame) -> bool:
    """True for a frame straight from the state operator, which knows each row's predecessor."""
    return set(PREVIOUS) <= set(ledger.columns)


def flow_split(ledger: DataFrame) -> DataFrame:
    """Flows by sign of the deltas alone (interest counts as borrow and supply coming in)."""
    borrow, supply, zero = F.col("delta_borrow_assets"), F.col("delta_supply_assets"), F.lit(0)
    interest = F.when(F.col("event_type") == "AccrueInterest", borrow).otherwise(zero)
    flows = {
        "borrow_in_assets": F.greatest(borrow, zero),
        "borrow_out_assets": F.greatest(-borrow, zero),
        "supply_in_assets": F.greatest(supply, zero),
        "supply_out_assets": F.greatest(-supply, zero),
        "interest_assets": interest,
    }
    return ledger.withColumns({name: flow.cast("double") for name, flow in flows.items()})


def elasticity(
    ledger: DataFrame, *, seconds_per_year: int = SECONDS_PER_YEAR, eps_util: float = 1e-9
) -> DataFrame:
    """``borrow_apr``, its and utilization's change from row to row, and their ratio."""
    if not has_previous(ledger):
        ledger = with_previous(
            ledger, {"_prev_utilization": "utilization_rate", "_prev_rate": "borrow_rate_per_sec"}
        )
    year, zero = F.lit(float(seconds_per_year)), F.lit(0.0)
    df = ledger.withColumns(
        {
            "borrow_apr": F.col("borrow_rate_per_sec") * year,
            "delta_utilization": F.coalesce(F.col("utilization_rate") - F.col("_prev_utilization"), zero),
        }
    ).withColumn("delta_borrow_apr", F.coalesce(F.col("borrow_apr") - F.col("_prev_rate") * year, zero))
    ratio = ratio_or(F.col("delta_borrow_apr"), F.col("delta_utilization"), eps_util, 0.0)
    return df.withColumn("elasticity_apr_per_util", ratio)


def regime_flags(ledger: DataFrame) -> DataFrame:
    """1 where utilization is above 90, 95 and 99 percent."""
    util = F.col("utilization_rate")
    return ledger.withColumns(
        {f"regime_util_gt_{p}": (util > F.lit(p / 100)).cast("tinyint") for p in _REGIMES}
    )


_MEASURES = Measures(
    levels=("utilization_rate", "borrow_apr"),
    sums=(*_INTENSITIES.values(), "interest_assets", "_borrowed"),
    nullable=frozenset({"borrow_apr"}),
)


def _statistics(w: Window) -> list[Output]:
    lent = w.mean("_borrowed")
    return [
        (f"util_mean_{w.label}", w.mean("utilization_rate")),
        (f"util_std_{w.label}", w.std("utilization_rate")),
        (f"borrow_apr_mean_{w.label}", w.mean("borrow_apr")),
        (f"borrow_apr_std_{w.label}", w.std("borrow_apr")),
        *[
            (f"{name}_intensity_{w.label}", f"{w.sum(flow)} / {float(w.seconds)}D")
            for name, flow in _INTENSITIES.items()
        ],
        # A ratio to the mean outstanding borrow, not a rate per second.
        (
            f"interest_intensity_{w.label}",
            f"CASE WHEN {lent} > 0 THEN {w.sum('interest_assets')} / {lent} ELSE 0D END",
        ),
    ]


def market_indicators(
    ledger: DataFrame,
    *,
    windows: dict[str, int] | None = None,
    seconds_per_year: int = SECONDS_PER_YEAR,
    eps_util: float = 1e-9,
) -> DataFrame:
    """The ledger's 20 columns and the indicator features for each window (59 columns by default)."""
    windows = windows or INDICATOR_WINDOWS
    adjacent = has_previous(ledger)
    df = elasticity(ledger, seconds_per_year=seconds_per_year, eps_util=eps_util)
    df = regime_flags(flow_split(df)).withColumn("_borrowed", F.col("outstanding_borrow_assets").cast("double"))
    keep = [*LEDGER.names, "borrow_apr", *_INTENSITIES.values(), "interest_assets", "_borrowed",
            "delta_borrow_apr", "elasticity_apr_per_util", *[f"regime_util_gt_{p}" for p in _REGIMES], *([CELL] if CELL in df.columns else [])]
    df = rolling(df.select(*keep), _MEASURES, windows, _statistics, repeats=not adjacent)
    if "6h" in windows:
        df = df.withColumn("borrow_apr_6h_avg_ui", F.col("borrow_apr_mean_6h"))
    fields = with_amounts(indicator_schema(windows), amount_type_of(ledger)).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
