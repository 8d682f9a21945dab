"""Running market state: totals, carried-forward rate, utilization, yields and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions import annual_yield, utilization
from poolscope.operators.ordered import CELL, LOGS_PER_CELL, Running, cell_of, ledger_levels, running
from poolscope.schemas import LEDGER, SECONDS_PER_YEAR, WIDE, amount_type_of

TOTALS = {
    "total_supplied_assets": "delta_supply_assets",
    "outstanding_borrow_assets": "delta_borrow_assets",
    "total_collateral_assets": "delta_collateral_assets",
}
PREVIOUS = ("_prev_supply", "_prev_utilization", "_prev_rate", "_first_row")


def require_rows(df: DataFrame, context: str = "ledger") -> DataFrame:
    """The frame itself, or ValueError if it has no rows (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"{context}: no rows; check that the event tables were loaded")
    return df


def _leading(rate: Column, mode: str) -> Column:
    if mode == "null":
        return rate
    if mode == "zero":
        return F.coalesce(rate, F.lit(0.0))
    if mode == "error":
        message = F.lit("borrow_rate_per_sec is null before the first interest event")
        return F.coalesce(rate, F.raise_error(message).cast("double"))
    raise ValueError("leading_rate must be 'null', 'zero' or 'error'")


def with_running_state(
    raw: DataFrame,
    *,
    leading_rate: str = "null",
    logs_per_cell: int | None = None,
    blocks_per_span: int | None = None,
) -> DataFrame:
    """The raw ledger with running totals, the carried rate and the row number per market.

    Also appends the previous row's rate (`_prev_rate`); every other previous-row value follows
    exactly from the row itself, since a total before the event is the total less the delta. The cell
    is kept too: the rows stay partitioned by (market, block, cell) for the steps that follow.
    """
    raw = raw.withColumn(CELL, cell_of(logs_per_cell or LOGS_PER_CELL))
    sizes = {"logs_per_cell": logs_per_cell, "blocks_per_span": blocks_per_span}
    levels = ledger_levels(**{k: v for k, v in sizes.items() if v})
    rate = F.col("borrow_rate_per_sec")
    # Wide sums: a part of one may pass 64 bits where the total doesn't.
    kind = amount_type_of(raw)
    items = [Running("sum", F.col(delta).cast(WIDE), upto=total) for total, delta in TOTALS.items()]
    items.append(Running("last", rate, upto="_rate", before="_prev_rate"))
    items.append(Running("sum", F.lit(1).cast("bigint"), upto="_row"))
    out = running(raw, items, part=["market_id"], order=["log_index"], levels=levels)
    first = F.col("_row") == 1
    return out.withColumns(
        {
            "borrow_rate_per_sec": _leading(F.col("_rate"), leading_rate),
            **{total: F.col(total).cast(kind) for total in TOTALS},
            # The first row has no previous row, whatever the leading rate is set to.
            "_prev_rate": F.when(~first, _leading(F.col("_prev_rate"), leading_rate)),
        }
    ).drop("_rate")


def state_frame(
    raw: DataFrame,
    *,
    seconds_per_year: int = SECONDS_PER_YEAR,
    leading_rate: str = "null",
    logs_per_cell: int | None = None,
    blocks_per_span: int | None = None,
) -> DataFrame:
    """The 20-column ledger plus the previous-row columns in ``PREVIOUS`` and the cell."""
    df = with_running_state(
        raw,
        leading_rate=leading_rate,
        logs_per_cell=logs_per_cell,
        blocks_per_span=blocks_per_span,
    )
    supply, borrow = F.col("total_supplied_assets"), F.col("outstanding_borrow_assets")
    first = F.col("_row") == 1
    df = df.withColumns(
        {
            "utilization_rate": utilization(supply, borrow),
            "_first_row": first,
            "_prev_supply": F.when(~first, supply - F.col("delta_supply_assets")),
            "_prev_utilization": F.when(
                ~first,
                utilization(
                    supply - F.col("delta_supply_assets"), borrow - F.col("delta_borrow_assets")
                ),
            ),
        }
    )
    rate, util = F.col("borrow_rate_per_sec"), F.col("utilization_rate")
    prev_rate, prev_util = F.col("_prev_rate"), F.col("_prev_utilization")
    df = df.withColumn("supply_rate_per_sec", util * rate).withColumns(
        {
            "borrow_apy": annual_yield(rate, seconds_per_year),
            "supply_apy": annual_yield(F.col("supply_rate_per_sec"), seconds_per_year),
            "_prev_borrow_apy": annual_yield(prev_rate, seconds_per_year),
            "_prev_supply_apy": annual_yield(prev_util * prev_rate, seconds_per_year),
        }
    )

    def change(now: str, before: str) -> Column:
        return F.when(first, F.lit(0.0)).otherwise(F.col(now) - F.col(before))

    df = df.withColumns(
        {
            "delta_utilization": change("utilization_rate", "_prev_utilization"),
            "delta_borrow_apy": change("borrow_apy", "_prev_borrow_apy"),
            "delta_supply_apy": change("supply_apy", "_prev_supply_apy"),
        }
    )
    return df.select(*LEDGER.names, *PREVIOUS, CELL)


def enriched_ledger(raw: DataFrame, **options) -> DataFrame:
    """The 20-column ledger: running totals, carried rate, utilization, yields and their changes.

    ``leading_rate`` says what holds before a market's first interest event: ``null`` (default),
    ``zero``, or ``error`` to refuse such a ledger.
    """
    return state_frame(raw, **options).select(*LEDGER.names)


def with_previous(df: DataFrame, columns: dict[str, str], *, with_time: bool = True) -> DataFrame:
    """Previous row's values per market, as ``{new name: column}``, and ``_first_row``.

    Works on any ledger, also one whose rows are no longer adjacent events (ticks, blocks,
    downsampled rows). Without ``with_time`` a (block, log) pair must be unique.
    """
    items = [Running("row", F.col(c), before=n) for n, c in columns.items()]
    items.append(Running("sum", F.lit(1).cast("bigint"), upto="_row"))
    order = ["log_index"]
    levels = ledger_levels(with_time=with_time)
    out = running(df, items, part=["market_id"], order=order, levels=levels)
    return out.withColumn("_first_row", F.col("_row") == 1).drop("_row")
