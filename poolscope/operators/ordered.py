"""Running aggregates over a long ordered series without putting the series in one task.

``Window.partitionBy(market).orderBy(...)`` sends a whole market to one task. Here the order is cut
into nested pieces by columns that respect it, for example

    rows  ->  (block, log_index div 16777216)  ->  block div 4096  ->  market

Each level holds a bounded number of entries per group, because its members are unique integers
within a fixed range. A level's totals are ordinary aggregates (partial sums before the shuffle); the
prefix of a piece is found on the next, much smaller level and joined back on the piece's key, which
is also the key the rows are already partitioned by, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOGS_PER_CELL = 16_777_216
BLOCKS_PER_SPAN = 4_096
CELL = "_cell"

Level = Sequence[tuple[str, Column]]


@dataclass(frozen=True)
class Running:
    """One running aggregate.

    kind is ``sum``, ``max``, ``last`` (last non-null value) or ``row`` (the value of the last row,
    null or not). ``upto`` names the result that includes the current row, ``before`` the one that
    excludes it (``row`` with ``before`` is a lag by one).
    """

    kind: str
    col: Column
    upto: str | None = None
    before: str | None = None

    def total(self, order: Sequence[str]) -> Column:
        key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
        if self.kind == "sum":
            return F.sum(self.col)
        if self.kind == "max":
            return F.max(self.col)
        if self.kind == "last":
            return F.max_by(self.col, F.when(self.col.isNotNull(), key))
        return F.max_by(self.col, key)

    def over(self, frame) -> Column:
        if self.kind == "sum":
            return F.sum(self.col).over(frame)
        if self.kind == "max":
            return F.max(self.col).over(frame)
        return F.last(self.col, ignorenulls=self.kind == "last").over(frame)

    def merge(self, carry: Column, local: Column, local_empty: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carry + local, local, carry)
        if self.kind == "max":
            return F.greatest(carry, local)
        if self.kind == "last":
            return F.coalesce(local, carry)
        return F.when(local_empty, carry).otherwise(local)


def running(
    df: DataFrame,
    items: Sequence[Running],
    *,
    part: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Level] = (),
) -> DataFrame:
    """Append running aggregates of ``df`` per ``part`` along ``order``.

    ``levels`` lists the pieces from fine to coarse as (name, expression) pairs over the columns of
    the level before; each must be non-decreasing along the order.
    """
    added = [n for i in items for n in (i.upto, i.before) if n]
    base = df.columns
    if not levels:
        by_order = Window.partitionBy(*part).orderBy(*order)
        upto = by_order.rowsBetween(Window.unboundedPreceding, 0)
        before = by_order.rowsBetween(Window.unboundedPreceding, -1)
        cols = [i.over(upto).alias(i.upto) for i in items if i.upto]
        cols += [i.over(before).alias(i.before) for i in items if i.before]
        return df.select("*", *cols)

    piece = [name for name, _ in levels[0]]
    own = [name for name in piece if name not in base]
    cut = df.withColumns({name: expr for name, expr in levels[0] if name in own})
    keys = [*part, *piece]

    totals = cut.groupBy(*keys).agg(*[i.total(order).alias(f"_t{k}") for k, i in enumerate(items)])
    carries = running(
        totals,
        [
            replace(i, col=F.col(f"_t{k}"), upto=None, before=f"_c{k}")
            for k, i in enumerate(items)
        ],
        part=part,
        order=piece,
        levels=levels[1:],
    ).select(*keys, *[f"_c{k}" for k in range(len(items))])

    by_order = Window.partitionBy(*keys).orderBy(*order)
    upto = by_order.rowsBetween(Window.unboundedPreceding, 0)
    before = by_order.rowsBetween(Window.unboundedPreceding, -1)
    local = [i.over(upto).alias(f"_u{k}") for k, i in enumerate(items) if i.upto]
    local += [i.over(before).alias(f"_b{k}") for k, i in enumerate(items) if i.before]
    needs_first = any(i.kind == "row" for i in items)
    first = [(F.row_number().over(by_order) == 1).alias("_first")] if needs_first else []

    joined = cut.select("*", *local, *first).join(carries, keys, "left")
    merged = {}
    for k, i in enumerate(items):
        if i.upto:
            merged[i.upto] = i.merge(F.col(f"_c{k}"), F.col(f"_u{k}"), F.lit(False))
        if i.before:
            local_empty = F.col("_first") if needs_first else F.lit(False)
            merged[i.before] = i.merge(F.col(f"_c{k}"), F.col(f"_b{k}"), local_empty)
    return joined.select(*base, *[merged[n].alias(n) for n in added])


def cell_of(logs_per_cell: int = LOGS_PER_CELL) -> Column:
    return F.expr(f"log_index div {int(logs_per_cell)}")


def ledger_levels(
    *,
    with_time: bool = False,
    logs_per_cell: int = LOGS_PER_CELL,
    blocks_per_span: int = BLOCKS_PER_SPAN,
) -> list[Level]:
    """Pieces of the ledger order (block_number, log_index).

    ``with_time`` is for ledgers where a (block, log) pair can repeat at another time, as in filled
    ticks: the order is then (block_timestamp, block_number, log_index) and spans cut the time.
    """
    cell = (CELL, cell_of(logs_per_cell))
    block = ("block_number", F.col("block_number"))
    if with_time:
        time = ("block_timestamp", F.col("block_timestamp"))
        return [[time, block, cell], [("_span", F.expr("block_timestamp div 86400"))]]
    return [[block, cell], [("_span", F.expr(f"block_number div {int(blocks_per_span)}"))]]


def ledger_order(*, with_time: bool = False) -> list[str]:
    """Order columns that go with :func:`ledger_levels`, within a cell."""
    return ["block_timestamp", "block_number", "log_index"] if with_time else ["log_index"]
