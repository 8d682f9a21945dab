"""Contracts on columns, and data checks that report or raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.operators.ordered import BLOCKS_PER_SPAN, CELL, cell_of
from poolscope.schemas import ATTRIBUTION_CORE, LEDGER, RAW_LEDGER, event_schema, indicator_schema

#: The whole-number amounts of the attribution table.
INTEGER_COLUMNS = tuple(
    f.name for f in ATTRIBUTION_CORE.fields if isinstance(f.dataType, T.LongType) and f.name.endswith("_assets")
)


def require_schema(
    df: DataFrame, expected: T.StructType, *, context: str, allow_extra: bool = False, in_order: bool = False
) -> DataFrame:
    """The frame itself, or ValueError on missing or extra columns (types are not compared)."""
    missing = [c for c in expected.names if c not in df.columns]
    extra = [] if allow_extra else [c for c in df.columns if c not in expected.names]
    if missing or extra:
        raise ValueError(f"{context}: missing columns {missing}, extra columns {extra}")
    if in_order and df.columns != expected.names:
        raise ValueError(f"{context}: columns out of order, expected {expected.names}")
    return df


def require_event(df: DataFrame, event: str) -> DataFrame:
    """A raw event table with all declared columns (others are allowed)."""
    return require_schema(df, event_schema(event), context=f"event {event}", allow_extra=True)


def require_raw_ledger(df: DataFrame) -> DataFrame:
    return require_schema(df, RAW_LEDGER, context="raw ledger", in_order=True)


def require_ledger(df: DataFrame) -> DataFrame:
    return require_schema(df, LEDGER, context="ledger", allow_extra=True)


def require_indicators(df: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    return require_schema(df, indicator_schema(windows), context="indicators")


def require_attribution(df: DataFrame) -> DataFrame:
    return require_schema(df, ATTRIBUTION_CORE, context="attribution", allow_extra=True)


def require_integers(df: DataFrame, columns: Sequence[str], *, context: str) -> DataFrame:
    """The frame itself; KeyError, TypeError or ValueError if a column is absent, no whole-number type, or has nulls."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"{context}: no such amounts: {absent}")
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, T.LongType) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
            raise TypeError(f"{context}: amounts are bigint or decimal(n,0), but {c} is {kind.simpleString()}")
    found = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    unset = {c: found[c] for c in columns if found[c]}
    if unset:
        raise ValueError(f"{context}: amounts not set, rows by column: {unset}")
    return df


def require_utilization(df: DataFrame, *, column: str = "utilization_rate", context: str) -> DataFrame:
    """The frame itself; error if utilization is absent, undefined, or outside [0, 1] by more than 1e-12."""
    if column not in df.columns:
        raise KeyError(f"{context}: no column {column}")
    u = F.col(column)
    seen = df.agg(
        F.count_if(u.isNull() | F.isnan(u)).alias("undefined"), F.min(u).alias("low"), F.max(u).alias("high")
    ).first()
    if seen["undefined"]:
        raise ValueError(f"{context}: {seen['undefined']} rows have no {column}")
    if seen["low"] is not None and (seen["low"] < -1e-12 or seen["high"] > 1 + 1e-12):
        raise ValueError(f"{context}: {column} runs from {seen['low']} to {seen['high']}, beyond a share")
    return df


def _merged(name: str) -> Column:
    """How an aggregate of chunks merges: one named _max by the largest, all others by adding."""
    return (F.max if name.endswith("_max") else F.sum)(name).alias(name)


def _chunk_edges(rows: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Per market and span of blocks: ``aggregates``, and what decides whether time runs on across spans.

    Order is checked by merging: a cell (market, block, logs) knows its first and last time and the steps back inside
    it; cells in a row add the steps back between them, spans likewise. Only cells and spans travel, never rows.
    """
    key = ["market_id", "block_number", CELL]
    cut = rows.withColumn(CELL, cell_of())
    inside = Window.partitionBy(*key).orderBy("log_index", "block_timestamp")
    cut = cut.withColumn("_back", (F.col("block_timestamp") < F.lag("block_timestamp").over(inside)).cast("int"))
    at = F.struct("log_index", "block_timestamp")
    cells = cut.groupBy(*key).agg(
        F.min_by("block_timestamp", at).alias("_first"), F.max_by("block_timestamp", at).alias("_last"),
        F.min("block_timestamp").alias("_lo"), F.max("block_timestamp").alias("_hi"),
        F.coalesce(F.sum("_back"), F.lit(0)).alias("_steps"), *[a.alias(n) for n, a in aggregates.items()],
    )
    cells = cells.withColumn("_span", F.expr(f"block_number div {BLOCKS_PER_SPAN}"))
    span = Window.partitionBy("market_id", "_span")
    block = Window.partitionBy("market_id", "_span", "block_number")
    by_cell, by_log = span.orderBy("block_number", CELL), block.orderBy(CELL)
    cells = cells.withColumns({
        "_between": (F.col("_first") < F.lag("_last").over(by_cell)).cast("int"),
        "_split": (F.row_number().over(by_log) == 1) & (F.min("_lo").over(block) < F.max("_hi").over(block)),
    })
    order = F.struct("block_number", CELL)
    return cells.groupBy("market_id", "_span").agg(
        F.min_by("_first", order).alias("_first"), F.max_by("_last", order).alias("_last"),
        (F.sum("_steps") + F.coalesce(F.sum("_between"), F.lit(0))).alias("_steps"), F.count_if("_split").alias("_splits"),
        *[_merged(n) for n in aggregates],
    )


def _by_market(rows: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Per market: ``aggregates``, backward_rows and split_blocks, in one pass over the rows."""
    spans = _chunk_edges(rows, aggregates)
    back = (F.col("_first") < F.lag("_last").over(Window.partitionBy("market_id").orderBy("_span"))).cast("int")
    return spans.withColumn("_between", back).groupBy("market_id").agg(
        (F.sum("_steps") + F.coalesce(F.sum("_between"), F.lit(0))).alias("backward_rows"), F.sum("_splits").alias("split_blocks"),
        *[_merged(n) for n in aggregates],
    )


def timestamp_order(ledger: DataFrame) -> DataFrame:
    """Per market: rows whose timestamp is before the previous row's (windows need none), and blocks
    seen with more than one timestamp."""
    return _by_market(ledger, {"rows": F.count(F.lit(1))}).select("market_id", "rows", "backward_rows", "split_blocks")


def require_time_order(ledger: DataFrame) -> DataFrame:
    """The frame itself; ValueError if time runs backward in a market, or a block has two timestamps. Runs a job."""
    bad = timestamp_order(ledger).where("backward_rows > 0 OR split_blocks > 0").orderBy("market_id").limit(5).collect()
    if bad:
        told = ", ".join(f"{r['market_id']}: {r['backward_rows']} rows back, {r['split_blocks']} blocks split" for r in bad)
        raise ValueError(f"timestamps are not in ledger order ({told})")
    return ledger


def integrity_report(attribution: DataFrame, *, max_residual_abs: float = 0.01) -> DataFrame:
    """One row per market and check: severity, violations, largest value seen, passed.

    Errors: nulls in integer columns, utilization outside [0, 1], flows that do not add up to the borrow
    delta, timestamps that run backward or differ within a block (``timestamp_order``, on the rows' keys). Warnings: more than 5% of rows with a large residual, interest rows whose supply or borrow
    delta is not the interest.
    """
    col, zero = F.col, F.lit(0.0)
    nulls = F.lit(0)
    for c in INTEGER_COLUMNS:
        if c in attribution.columns:
            nulls = nulls + col(c).isNull().cast("int")
    u = col("utilization_rate")
    off = F.abs(
        col("borrow_in_assets") - col("repay_out_assets") - col("liquidate_repay_assets")
        + col("interest_assets") - col("delta_borrow_assets").cast("double")
    )
    residual = F.abs(col("delta_u_residual"))
    accrues = col("event_type") == "AccrueInterest"
    apart = {
        side: F.abs(col(f"delta_{side}_assets").cast("double") - col("interest_assets"))
        for side in ("supply", "borrow")
    }
    allowed = F.lit(1.0) + F.lit(1e-5) * F.abs(col("interest_assets"))
    one = _by_market(attribution, {
        "rows": F.count(F.lit(1)),
        "nulls": F.sum(nulls).cast("bigint"),
        "outside": F.count_if((u < 0) | (u > 1)),
        "outside_max": F.max(F.when(u < 0, -u).otherwise(u)),
        "identity": F.count_if(off > 1.0),
        "identity_max": F.max(off),
        "residual": F.count_if(residual > max_residual_abs),
        "residual_max": F.max(residual),
        **{f"interest_{s}": F.count_if(accrues & (d > allowed)) for s, d in apart.items()},
        **{f"interest_{s}_max": F.max(F.when(accrues, d)) for s, d in apart.items()},
    }).withColumn("disorder", col("backward_rows") + col("split_blocks"))
    lines = [
        ("integer_nulls", "error", col("nulls"), col("nulls").cast("double"), col("nulls") == 0),
        ("utilization_bounds", "error", col("outside"), col("outside_max"), col("outside") == 0),
        ("flow_identity", "error", col("identity"), col("identity_max"), col("identity") == 0),
        ("residual_size", "warning", col("residual"), col("residual_max"),
         col("residual") <= col("rows") * F.lit(0.05)),
        *[
            (f"interest_equals_{s}_delta", "warning", col(f"interest_{s}"),
             F.coalesce(col(f"interest_{s}_max"), zero), col(f"interest_{s}") == 0)
            for s in apart
        ],
        ("timestamp_order", "error", col("disorder"), col("disorder").cast("double"), col("disorder") == 0),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"), F.lit(severity).alias("severity"),
                violations.alias("violations"), largest.alias("max_value"), passed.alias("passed"),
            )
            for name, severity, violations, largest, passed in lines
        ]
    )
    return one.select("market_id", F.inline(rows))


def passed(report: DataFrame) -> DataFrame:
    """Verdict per market: false if an error-level check failed; warnings do not count."""
    failed = lambda severity: F.collect_list(
        F.when(~F.col("passed") & (F.col("severity") == severity), F.col("check"))
    )
    return report.groupBy("market_id").agg(
        F.bool_and(F.col("passed") | (F.col("severity") != "error")).alias("passed"),
        F.array_sort(failed("error")).alias("errors"),
        F.array_sort(failed("warning")).alias("warnings"),
    )
