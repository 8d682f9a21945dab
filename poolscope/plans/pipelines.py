"""From event tables to finished datasets, of all markets at once.

``tick_dataset`` settles the condensed rows and ``ledger_state`` the parsed events (so do the datasets with windows, which start
from it): these run a job when called. All others are lazy.
Common options: ``seconds_per_year`` holds for every yield and rate of a dataset; ``leading_rate`` says what
holds before a market's first interest event; ``amount_type`` is bigint or, for larger amounts,
decimal(38,0), and is kept by every integer column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from poolscope.operators.attribution import attribution
from poolscope.operators.checks import integrity_report, require_time_order
from poolscope.operators.indicators import market_indicators
from poolscope.operators.standardize import raw_ledger_together
from poolscope.operators.state import state_frame
from poolscope.operators.ticks import aggregate_ledger
from poolscope.schemas import LEDGER, SECONDS_PER_YEAR
from poolscope.session import settled
from poolscope.sources.events import EventStore

Markets = str | Iterable[str] | None


def ledger_state(store: EventStore, market_ids: Markets = None, *, amount_type: str = "bigint", **options) -> DataFrame:
    """Scan, standardize, running state; keeps the previous-row columns for the steps that follow.

    Windows read the state twice and the state its events twice, each time with other columns, so the plan would scan and
    parse all events four times. The parsed events are settled here: a job when called, and amounts that are no numbers
    fail in it.
    """
    return state_frame(settled(_raw(store, market_ids, amount_type)), **options)


def _raw(store: EventStore, market_ids: Markets, amount_type: str) -> DataFrame:
    return raw_ledger_together(store.read_together(market_ids), amount_type=amount_type)


def enriched_ledger_dataset(
    store: EventStore, market_ids: Markets = None, *, amount_type: str = "bigint", **options
) -> DataFrame:
    """The 20-column ledger."""
    return state_frame(_raw(store, market_ids, amount_type), **options).select(*LEDGER.names)


def tick_dataset(
    store: EventStore,
    market_ids: Markets = None,
    *,
    tick_seconds: int = 300,
    aggregation_level: str = "tick",
    fill: str = "last",
    **options,
) -> DataFrame:
    """The ledger condensed to ticks or blocks."""
    ledger = enriched_ledger_dataset(store, market_ids, **options)
    return aggregate_ledger(
        ledger, aggregation_level=aggregation_level, tick_seconds=tick_seconds, fill=fill
    )


def indicator_dataset(
    store: EventStore,
    market_ids: Markets = None,
    *,
    windows: dict[str, int] | None = None,
    seconds_per_year: int = SECONDS_PER_YEAR,
    **options,
) -> DataFrame:
    """The ledger with rolling indicators."""
    ledger = ledger_state(store, market_ids, seconds_per_year=seconds_per_year, **options)
    return market_indicators(ledger, windows=windows, seconds_per_year=seconds_per_year)


def attribution_dataset(
    store: EventStore | None = None,
    market_ids: Markets = None,
    *,
    ledger: DataFrame | None = None,
    compute_windows: Iterable[str] | None = None,
    validate: bool = True,
    seconds_per_year: int = SECONDS_PER_YEAR,
    leading_rate: str = "null",
    amount_type: str = "bigint",
    refuse_unordered: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame | None]:
    """The attribution table and its integrity report (None unless ``validate``).

    Starts from a store, or from any frame with the ledger's columns, to which ``leading_rate`` and
    ``amount_type`` don't apply. Windows need timestamps in order: the report has a line on it, and
    ``refuse_unordered`` raises before any window is planned (a job over the ledger's keys).
    """
    if ledger is None:
        if store is None:
            raise ValueError("give a store or a ledger")
        ledger = ledger_state(
            store, market_ids, seconds_per_year=seconds_per_year, leading_rate=leading_rate, amount_type=amount_type
        )
    if refuse_unordered:
        require_time_order(ledger)
    table = attribution(ledger, compute_windows=compute_windows, seconds_per_year=seconds_per_year, **options)
    # The checks read per-row columns only; the optimizer drops the windows from that plan.
    return table, integrity_report(table) if validate else None
