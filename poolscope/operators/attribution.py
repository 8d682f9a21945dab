"""Utilization changes split into flow contributions, with rate response and window statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.functions import ratio_or
from poolscope.operators.indicators import has_previous
from poolscope.operators.ordered import CELL
from poolscope.operators.rolling import EXPANDING, Measures, Output, Window, rolling
from poolscope.operators.state import PREVIOUS, with_previous
from poolscope.operators.ticks import first_last_per_tick
from poolscope.schemas import (
    AGGREGATED, ATTRIBUTION_CORE, ATTRIBUTION_WINDOWS, FLOW_RULES, SECONDS_PER_YEAR, amount_type_of,
)

# Guards against dividing by (almost) nothing, and the winsorizing bound of the slope.
EPS_U = 1e-9
EPS_CONTRIB = 1e-12
MIN_VARIANCE = 1e-12
SLOPE_BOUND = 1_000

_FLOWS = ("borrow_in_assets", "repay_out_assets", "liquidate_repay_assets", "supply_in_assets", "withdraw_out_assets",
          "interest_assets")
_SHARED = ("withdraw", "repay", "liquidate", "borrow", "supply")


def state_levels(ledger: DataFrame, *, seconds_per_year: int = SECONDS_PER_YEAR) -> DataFrame:
    """APR, unused share of supply, and what can still be borrowed up to 90 and 95 percent."""
    room = lambda share: (
        F.lit(share) * F.col("total_supplied_assets").cast("double")
        - F.col("outstanding_borrow_assets").cast("double")
    ).cast(amount_type_of(ledger))
    return ledger.withColumns(
        {
            "borrow_apr": F.col("borrow_rate_per_sec") * F.lit(float(seconds_per_year)),
            "buffer": F.greatest(F.lit(1.0) - F.col("utilization_rate"), F.lit(0.0)),
            "headroom_u90_assets": room(0.90),
            "headroom_u95_assets": room(0.95),
        }
    )


def event_flows(ledger: DataFrame) -> DataFrame:
    """Six flows by event type and sign, and the two net flows.

    Rows of type 'Aggregated' (ticks, blocks) keep the flow totals they come with.
    """

    def flow(name: str):
        event, delta, sign = FLOW_RULES[name]
        moved = F.col(delta)
        if sign is not None:
            moved = F.greatest(moved * F.lit(sign), F.lit(0))
        picked = F.when(F.col("event_type") == event, moved).otherwise(F.lit(0)).cast("double")
        if name in ledger.columns:
            return F.when(F.col("event_type") == AGGREGATED, F.col(name).cast("double")).otherwise(picked)
        return picked

    df = ledger.withColumns({name: flow(name) for name in _FLOWS})
    return df.withColumns(
        {
            "net_borrow_principal_assets": F.col("borrow_in_assets")
            - F.col("repay_out_assets")
            - F.col("liquidate_repay_assets"),
            "net_supply_assets": F.col("supply_in_assets") - F.col("withdraw_out_assets"),
        }
    )


def contributions(ledger: DataFrame) -> DataFrame:
    """Each flow's first-order share in the change of utilization, their sum, and what is left over.

    Expects the flows and the previous row's state. Where there is no previous row the previous totals
    count as 0, so a first-row borrow contributes its raw amount; the residual check flags it.
    """
    base = F.greatest(F.coalesce(F.col("_prev_supply").cast("double"), F.lit(0.0)), F.lit(1.0))
    used = F.coalesce(F.col("_prev_utilization"), F.lit(0.0))
    df = ledger.withColumns({"_base": base, "_used": used})
    per = lambda flow: F.col(flow) / F.col("_base")
    parts = {
        "borrow": per("borrow_in_assets"),
        "repay": -per("repay_out_assets"),
        "liquidate": -per("liquidate_repay_assets"),
        "withdraw": F.col("_used") * per("withdraw_out_assets"),
        "supply": -F.col("_used") * per("supply_in_assets"),
        "interest": per("interest_assets") * (F.lit(1.0) - F.col("_used")),
    }
    df = df.withColumns({f"contrib_u_from_{name}": part for name, part in parts.items()})
    predicted = F.lit(0.0)
    for name in parts:
        predicted = predicted + F.col(f"contrib_u_from_{name}")
    df = df.withColumns(
        {
            "delta_u_pred": predicted,
            "delta_u_real": F.coalesce(
                F.col("utilization_rate") - F.col("_prev_utilization"), F.lit(0.0)
            ),
        }
    )
    return df.withColumn("delta_u_residual", F.col("delta_u_real") - F.col("delta_u_pred")).drop("_base", "_used")


def rate_response(
    ledger: DataFrame,
    *,
    seconds_per_year: int = SECONDS_PER_YEAR,
    eps_u: float = EPS_U,
    eps_contrib: float = EPS_CONTRIB,
) -> DataFrame:
    """APR change per unit of utilization change, and per contribution; null where that is ~0."""
    before = F.col("_prev_rate") * F.lit(float(seconds_per_year))
    df = ledger.withColumn("delta_borrow_apr", F.coalesce(F.col("borrow_apr") - before, F.lit(0.0)))
    moved = F.col("delta_borrow_apr")
    return df.withColumns(
        {
            "irm_slope": ratio_or(moved, F.col("delta_u_real"), eps_u, None),
            **{
                f"irm_response_to_{name}": ratio_or(
                    moved, F.col(f"contrib_u_from_{name}"), eps_contrib, None
                )
                for name in ("withdraw", "repay", "liquidate")
            },
        }
    )


_MEASURES = Measures(
    levels=("utilization_rate", "borrow_apr"),
    changes=("delta_u_real", "_slope"),
    sums=(*_FLOWS, "_supplied"),
    highs=("utilization_rate", "borrow_apr"),
    pairs=tuple((f"contrib_u_from_{name}", "delta_u_real") for name in _SHARED),
    nullable=frozenset({"borrow_apr"}),
)
_ALL_TIME = Measures(
    levels=("utilization_rate", "borrow_apr"),
    changes=("delta_u_real",),
    highs=("utilization_rate", "borrow_apr"),
    nullable=frozenset({"borrow_apr"}),
)


def _statistics(w: Window) -> list[Output]:
    label = w.label
    if w.seconds is None:
        return [
            (f"util_mean_{label}", w.mean("utilization_rate")),
            (f"util_std_{label}", w.std("utilization_rate")),
            (f"util_max_{label}", w.max("utilization_rate")),
            (f"borrow_apr_mean_{label}", w.mean("borrow_apr")),
            (f"borrow_apr_std_{label}", w.std("borrow_apr")),
            (f"borrow_apr_max_{label}", w.max("borrow_apr")),
            (f"delta_u_std_{label}", w.std("delta_u_real")),
        ]
    speed = lambda flow: f"{w.sum(flow)} / {float(w.seconds)}D"
    pushed = lambda name: w.sum(f"contrib_u_from_{name}")
    flows = {
        "borrow": "borrow_in_assets",
        "repay": "repay_out_assets",
        "liquidate": "liquidate_repay_assets",
        "withdraw": "withdraw_out_assets",
        "supply": "supply_in_assets",
        "interest": "interest_assets",
    }
    # Contributions have a fixed sign per flow, so sums of absolute values are sums up to sign.
    sign = {"withdraw": "", "repay": "-", "liquidate": "-"}
    share = lambda name: w.cov(f"contrib_u_from_{name}", "delta_u_real")
    return [
        (f"util_mean_{label}", w.mean("utilization_rate")),
        (f"util_max_{label}", w.max("utilization_rate")),
        (f"util_std_{label}", w.std("utilization_rate")),
        (f"buffer_min_{label}", f"greatest(1D - {w.max('utilization_rate')}, 0D)"),
        (f"borrow_apr_mean_{label}", w.mean("borrow_apr")),
        (f"borrow_apr_max_{label}", w.max("borrow_apr")),
        (f"borrow_apr_std_{label}", w.std("borrow_apr")),
        *[(f"{name}_intensity_{label}", speed(flow)) for name, flow in flows.items()],
        *[
            (
                f"{name}_intensity_norm_supply_{label}",
                f"{speed(flows[name])} / greatest({w.mean('_supplied')}, 1D)",
            )
            for name in ("borrow", "withdraw", "repay")
        ],
        *[(f"contrib_{name}_sum_{label}", pushed(name)) for name in _SHARED],
        *[(f"contrib_{name}_abs_sum_{label}", f"{sign[name]}{pushed(name)} + 0D") for name in sign],
        (f"delta_u_std_{label}", w.std("delta_u_real")),
        (f"irm_slope_std_{label}", w.std("_slope")),
        *[
            (
                f"vol_share_{name}_{label}",
                f"({share(name)}) / greatest({w.var('delta_u_real')}, {MIN_VARIANCE}D)",
            )
            for name in _SHARED
        ],
    ]


def attribution_core(
    ledger: DataFrame,
    *,
    seconds_per_year: int = SECONDS_PER_YEAR,
    eps_u: float = EPS_U,
    eps_contrib: float = EPS_CONTRIB,
    first_last_only: bool = False,
    tick_seconds: int = 300,
) -> DataFrame:
    """The per-row part: 20 ledger columns and 26 attribution columns, other columns kept after them.

    Takes any frame with the ledger's columns: events, blocks or ticks. ``first_last_only`` first
    reduces every market to the first and last row of each tick; changes then span the dropped rows while
    flows do not, so residuals grow. A tick ledger avoids that.
    """
    return _core(ledger, seconds_per_year, eps_u, eps_contrib, first_last_only, tick_seconds).drop(CELL)


def _core(
    ledger: DataFrame,
    seconds_per_year: int,
    eps_u: float,
    eps_contrib: float,
    first_last_only: bool,
    tick_seconds: int,
) -> DataFrame:
    if first_last_only:
        ledger = first_last_per_tick(ledger.drop(*PREVIOUS, CELL), tick_seconds=tick_seconds)
    if not has_previous(ledger):
        ledger = with_previous(
            ledger,
            {
                "_prev_supply": "total_supplied_assets",
                "_prev_utilization": "utilization_rate",
                "_prev_rate": "borrow_rate_per_sec",
            },
        )
    df = state_levels(ledger, seconds_per_year=seconds_per_year)
    df = contributions(event_flows(df))
    df = rate_response(df, seconds_per_year=seconds_per_year, eps_u=eps_u, eps_contrib=eps_contrib)
    core = ATTRIBUTION_CORE.names
    return df.select(*core, *[c for c in df.columns if c not in core and c not in PREVIOUS])


def chosen_windows(
    windows: dict[str, int] | None = None, compute_windows: Iterable[str] | None = None
) -> dict[str, int]:
    """The windows to compute, in the order of ``windows``; ``compute_windows=None`` means all."""
    windows = dict(windows or ATTRIBUTION_WINDOWS)
    if compute_windows is None:
        return windows
    wanted = list(compute_windows)
    unknown = [w for w in wanted if w not in windows]
    if unknown:
        raise KeyError(f"unknown windows {unknown}; known: {list(windows)}")
    return {label: s for label, s in windows.items() if label in wanted}


def attribution_windows(
    core: DataFrame, *, windows: dict[str, int] | None = None, expanding: bool = True, repeats: bool = True
) -> DataFrame:
    """Append 31 columns per window and the 7 all-time ones to the per-row part."""
    bound = F.lit(float(SLOPE_BOUND))
    slope = F.greatest(-bound, F.least(bound, F.coalesce(F.col("irm_slope"), F.lit(0.0))))
    df = core.withColumns({"_slope": slope, "_supplied": F.col("total_supplied_assets").cast("double")})
    labels: dict[str, int | None] = dict(windows if windows is not None else ATTRIBUTION_WINDOWS)
    measures = _MEASURES if labels else _ALL_TIME
    if expanding:
        labels[EXPANDING] = None
    return rolling(df, measures, labels, _statistics, repeats=repeats).drop("_slope", "_supplied")


def attribution(
    ledger: DataFrame,
    *,
    windows: dict[str, int] | None = None,
    compute_windows: Iterable[str] | None = None,
    expanding: bool = True,
    seconds_per_year: int = SECONDS_PER_YEAR,
    eps_u: float = EPS_U,
    eps_contrib: float = EPS_CONTRIB,
    first_last_only: bool = False,
    tick_seconds: int = 300,
) -> DataFrame:
    """The full attribution table: per-row part, window statistics, all-time statistics."""
    adjacent = has_previous(ledger) and not first_last_only
    core = _core(ledger, seconds_per_year, eps_u, eps_contrib, first_last_only, tick_seconds)
    chosen = chosen_windows(windows, compute_windows)
    return attribution_windows(core, windows=chosen, expanding=expanding, repeats=not adjacent)
