"""The event ledger condensed to time ticks, to blocks, or to the first and last row of each tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.operators.ordered import BLOCKS_PER_SPAN, Running, running
from poolscope.schemas import AGGREGATED, AGGREGATED_LEDGER, FLOW_RULES, FLOW_TOTALS, WIDE, amount_type_of, with_amounts
from poolscope.session import settled

_ROWS_PER_EXPLODE = 4_096
_TICKS_PER_SPAN = 4_096

_DELTAS = ["delta_supply_assets", "delta_borrow_assets", "delta_collateral_assets"]
# Columns an empty tick inherits.
_CARRIED = [
    "block_number", "log_index", "tx_hash",
    "total_supplied_assets", "outstanding_borrow_assets", "total_collateral_assets",
    "borrow_rate_per_sec", "utilization_rate", "borrow_apy", "supply_rate_per_sec", "supply_apy",
]
_CHANGES = {
    "delta_utilization": "utilization_rate",
    "delta_borrow_apy": "borrow_apy",
    "delta_supply_apy": "supply_apy",
}

def tick_of(timestamp: Column | str, tick_seconds: int) -> Column:
    """Start of the tick that holds a Unix second."""
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return ts - F.pmod(ts, F.lit(int(tick_seconds)))  # in whole numbers


def _flow(name: str) -> Column:
    event, delta, sign = FLOW_RULES[name]
    moved = F.col(delta)
    if sign is not None:
        moved = F.greatest(moved * F.lit(sign), F.lit(0))
    return F.when(F.col("event_type") == event, moved).otherwise(F.lit(0))


def _condense(ledger: DataFrame, key: Column, name: str) -> DataFrame:
    """One row per market and ``key``: summed deltas and flows, the last event's state, a count."""
    last = F.max_by(
        F.struct("block_timestamp", *_CARRIED), F.struct("block_number", "log_index")
    )
    return (
        ledger.withColumn(name, key)
        .groupBy("market_id", name)
        .agg(
            last.alias("_last"),
            # Wide sums: one may pass 64 bits on its way to a result that doesn't.
            *[F.sum(F.col(d).cast(WIDE)).alias(d) for d in _DELTAS],
            *[F.sum(_flow(f).cast(WIDE)).alias(f) for f in FLOW_TOTALS],
            F.count(F.lit(1)).alias("event_count"),
        )
    )


def _finish(df: DataFrame, amount_type: T.DataType) -> DataFrame:
    df = df.withColumn("event_type", F.lit(AGGREGATED))
    fields = with_amounts(AGGREGATED_LEDGER, amount_type).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def block_ledger(ledger: DataFrame) -> DataFrame:
    """One row per market and block; changes are between consecutive blocks."""
    blocks = _condense(ledger, F.col("block_number"), "_block").select("*", "_last.*").drop("_last", "_block")
    blocks = settled(blocks)
    items = [Running("row", F.col(c), before=f"_p_{c}") for c in _CHANGES.values()]
    items.append(Running("sum", F.lit(1).cast("bigint"), upto="_row"))
    blocks = running(
        blocks,
        items,
        part=["market_id"],
        order=["block_number"],
        levels=[[("_span", F.expr(f"block_number div {BLOCKS_PER_SPAN}"))]],
    )
    change = {
        d: F.when(F.col("_row") == 1, F.lit(0.0)).otherwise(F.col(c) - F.col(f"_p_{c}"))
        for d, c in _CHANGES.items()
    }
    return _finish(blocks.withColumns(change), amount_type_of(ledger))


def tick_ledger(ledger: DataFrame, *, tick_seconds: int = 300, fill: str = "last") -> DataFrame:
    """One row per market and tick, from the market's first tick to its last.

    An empty tick has zero deltas, flows and count, ends at its own upper bound, and inherits the
    state: with ``fill='last'`` that of the latest tick before it, with ``'running_max'`` the largest
    value seen so far, column by column.
    """
    if fill not in ("last", "running_max"):
        raise ValueError("fill must be 'last' or 'running_max'")
    n = int(tick_seconds)
    ticks = _condense(ledger, tick_of("block_timestamp", n), "tick").select("*", "_last.*").drop("_last")
    # Settled: the prefix levels read the ticks again, and would otherwise redo the ledger each time.
    ticks = settled(ticks)

    # Everything a gap needs is found on the non-empty ticks: the previous one, and what it carries.
    items = [Running("row", F.col(c), before=f"_p_{c}") for c in ("tick", *_CARRIED)]
    if fill == "running_max":
        items += [Running("max", F.col(c), upto=f"_m_{c}", before=f"_f_{c}") for c in _CARRIED]
    ticks = running(
        ticks,
        items,
        part=["market_id"],
        order=["tick"],
        levels=[[("_span", F.floor(F.col("tick") / F.lit(n * _TICKS_PER_SPAN)))]],
    )
    if fill == "running_max":
        fills = {c: F.col(f"_f_{c}") for c in _CARRIED}
        own = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in _CARRIED}
        before = {c: F.coalesce(F.col(f"_p_{c}"), F.col(f"_f_{c}")) for c in _CARRIED}
    else:
        fills = before = {c: F.col(f"_p_{c}") for c in _CARRIED}
        own = {c: F.col(c) for c in _CARRIED}

    # Each tick emits the empty ticks before it, then itself. Gaps are unfolded in two steps, so that
    # no array grows with the length of a gap.
    gap = F.coalesce((F.col("tick") - F.col("_p_tick")).cast("bigint") / F.lit(n) - 1, F.lit(0.0))
    step = F.lit(_ROWS_PER_EXPLODE)
    unfolded = (
        ticks.withColumn("_gap", gap.cast("bigint"))
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_gap"), step.cast("bigint"))))
        # A long gap's stretches go to many tasks before they unfold.
        .repartition("market_id", "tick", "_from")
        .withColumn(
            "_i", F.explode(F.sequence("_from", F.least(F.col("_from") + step - 1, F.col("_gap"))))
        )
    )
    filled = F.col("_i") < F.col("_gap")
    start = F.col("tick") - (F.col("_gap") - F.col("_i")) * F.lit(n)

    def value(c: str) -> Column:
        return F.when(filled, fills[c]).otherwise(own[c])

    def change(c: str) -> Column:
        return (
            F.when(F.col("_p_tick").isNull(), F.lit(0.0))
            .when(F.col("_i") == 0, value(c) - before[c])
            .otherwise(value(c) - fills[c])
        )

    zeroed = [*_DELTAS, *FLOW_TOTALS, "event_count"]
    out = unfolded.select(
        "market_id",
        F.when(filled, start + F.lit(n)).otherwise(F.col("block_timestamp")).alias("block_timestamp"),
        *[value(c).alias(c) for c in _CARRIED],
        *[F.when(filled, F.lit(0)).otherwise(F.col(c)).alias(c) for c in zeroed],
        *[change(c).alias(d) for d, c in _CHANGES.items()],
    )
    return _finish(out, amount_type_of(ledger))


def aggregate_ledger(
    ledger: DataFrame, *, aggregation_level: str = "tick", tick_seconds: int = 300, fill: str = "last"
) -> DataFrame:
    """Ticks or blocks, by name."""
    if aggregation_level == "block":
        return block_ledger(ledger)
    if aggregation_level == "tick":
        return tick_ledger(ledger, tick_seconds=tick_seconds, fill=fill)
    raise ValueError("aggregation_level must be 'tick' or 'block'")


def first_last_per_tick(ledger: DataFrame, *, tick_seconds: int = 300) -> DataFrame:
    """First and last row of every tick (one row where they coincide), columns unchanged, of every market."""
    position = F.struct("block_timestamp", "block_number", "log_index")
    row = F.struct(*[F.col(c) for c in ledger.columns])
    ends = ledger.groupBy("market_id", tick_of("block_timestamp", tick_seconds).alias("_tick")).agg(
        F.min_by(row, position).alias("_first"), F.max_by(row, position).alias("_last")
    )
    same = (F.col("_first.block_number") == F.col("_last.block_number")) & (F.col("_first.log_index") == F.col("_last.log_index"))
    return ends.select(F.inline(F.when(same, F.array("_first")).otherwise(F.array("_first", "_last"))))
