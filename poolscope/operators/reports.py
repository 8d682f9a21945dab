"""Summary queries over the ledger, the ticks and the attribution table; all per market."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope.operators.ordered import CELL, Running, ledger_levels, running
from poolscope.operators.quantiles import describe
from poolscope.session import settled

_MEASURES = ["total_supplied_assets", "outstanding_borrow_assets", "total_collateral_assets",
             "utilization_rate", "borrow_apy", "supply_apy"]
_FLOWS = ["borrow_in_assets", "repay_out_assets", "liquidate_repay_assets",
          "supply_in_assets", "withdraw_out_assets", "interest_assets"]


def raw_event_counts(events: dict[str, DataFrame]) -> DataFrame:
    """Rows per market in each raw event table."""
    counts = [
        df.groupBy(F.col("id").alias("market_id")).agg(F.count(F.lit(1)).alias("rows"))
        .select("market_id", F.lit(event).alias("event_type"), "rows")
        for event, df in events.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def event_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("market_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"))


def event_type_summary(ledger: DataFrame) -> DataFrame:
    """Per event type: count and mean utilization and yields, largest count first."""
    return (
        ledger.groupBy("market_id", "event_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.avg("utilization_rate").alias("avg_utilization"),
            F.avg("borrow_apy").alias("avg_borrow_apy"),
            F.avg("supply_apy").alias("avg_supply_apy"),
        )
        .orderBy(F.desc("event_count"), "market_id", "event_type")
    )


def latest_state(ledger: DataFrame) -> DataFrame:
    """The last row of each market: its position and the state measures."""
    last = F.max_by(F.struct("block_number", *_MEASURES), F.struct("block_number", "log_index"))
    return ledger.groupBy("market_id").agg(last.alias("_last")).select("market_id", "_last.*")


def latest_rows(df: DataFrame, columns: Sequence[str], rows: int = 1) -> DataFrame:
    """The last rows of each market, newest first (Spark keeps ``rows`` per task before it shuffles)."""
    newest = Window.partitionBy("market_id").orderBy(
        F.desc("block_timestamp"), F.desc("block_number"), F.desc("log_index")
    )
    ranked = df.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= rows)
    keys = [c for c in ("market_id", "age", "block_timestamp", "block_number", "log_index") if c not in columns]
    return ranked.select(*keys, *columns)


def ordered(df: DataFrame) -> DataFrame:
    """Rows in ledger order, market by market, for output."""
    return df.orderBy("market_id", "block_number", "log_index")


def output_positions(df: DataFrame) -> DataFrame:
    """The rows with their position, from 1, in the output order (block, log, market) of the whole table.

    Found by prefix counts over cells and spans of blocks, so the order is never one task's.
    """
    levels = ledger_levels()
    row = Running("sum", F.lit(1).cast("bigint"), upto="position")
    return running(df.drop(CELL), [row], part=[], order=["log_index", "market_id"], levels=levels)


def time_series(ledger: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows in ledger order, with the time as a timestamp."""
    return (
        ledger.orderBy("block_number", "log_index", "market_id")
        .limit(rows)
        .select(
            "market_id", "block_number", "log_index",
            F.timestamp_millis(F.col("block_timestamp") * 1_000).alias("timestamp"),
            "utilization_rate", "borrow_apy", "supply_apy",
            "total_supplied_assets", "outstanding_borrow_assets",
        )
    )


def tick_accounting(ticks: DataFrame) -> DataFrame:
    """For every tick of several events: do the flows add up to the borrow and the supply delta?"""
    flow = {
        "borrow": F.expr("borrow_in_assets - repay_out_assets - liquidate_repay_assets + interest_assets"),
        "supply": F.expr("supply_in_assets - withdraw_out_assets + interest_assets"),
    }
    df = ticks.where("event_count > 1").select(
        "market_id", "block_number", "block_timestamp", "event_count",
        *[f.alias(f"{side}_flows") for side, f in flow.items()],
        "delta_borrow_assets", "delta_supply_assets",
    )
    return df.withColumns(
        {f"{side}_match": F.abs(F.col(f"{side}_flows") - F.col(f"delta_{side}_assets")) < 1 for side in flow}
    )


def nonzero_flows(attribution: DataFrame) -> DataFrame:
    """Rows that move anything, with their six flows."""
    moves = reduce(lambda a, b: a | b, [F.col(f) != 0 for f in _FLOWS])
    return attribution.where(moves).select("market_id", "block_number", "log_index", "event_type", *_FLOWS)


def flow_totals(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("market_id").agg(*[F.sum(f).alias(f"total_{f}") for f in _FLOWS])


def significant_moves(attribution: DataFrame, *, threshold: float = 0.001) -> DataFrame:
    """Rows that move utilization by more than the threshold, with the contributions behind them."""
    parts = [f"contrib_u_from_{n}" for n in ("borrow", "repay", "liquidate", "withdraw", "supply", "interest")]
    return attribution.where(F.abs("delta_u_real") > threshold).select(
        "market_id", "block_number", "log_index", "event_type",
        "delta_u_real", "delta_u_pred", *parts, "delta_u_residual",
    )


def _share(df: DataFrame, large, name: str) -> DataFrame:
    return df.groupBy("market_id").agg(
        F.count_if(large).alias(name),
        (F.count_if(large) / F.count(F.lit(1))).alias(f"{name}_share"),
    )


def residual_summary(attribution: DataFrame, *, threshold: float = 0.01) -> DataFrame:
    """Distribution of the residuals, with the count and share of large ones."""
    rows = settled(attribution.select("market_id", "delta_u_residual"))
    large = F.abs("delta_u_residual") > threshold
    summary = describe(rows, ["delta_u_residual"], ready=True).drop("metric")
    return summary.join(_share(rows, large, "large_residuals"), "market_id")


def irm_summary(attribution: DataFrame, *, threshold: float = 1.0) -> DataFrame:
    """Distribution of the defined slopes, with the count and share of steep ones."""
    defined = settled(attribution.where("irm_slope IS NOT NULL").select("market_id", "irm_slope"))
    steep = F.abs("irm_slope") > threshold
    return describe(defined, ["irm_slope"], ready=True).drop("metric").join(_share(defined, steep, "steep_slopes"), "market_id")


def steep_slopes(attribution: DataFrame, *, threshold: float = 1.0) -> DataFrame:
    """Rows whose APR moves by more than ``threshold`` per unit of utilization."""
    return attribution.where(F.abs("irm_slope") > threshold).select(
        "market_id", "block_number", "log_index", "event_type", "delta_u_real", "delta_borrow_apr", "irm_slope",
        *[f"irm_response_to_{n}" for n in ("withdraw", "repay", "liquidate")],
    )


def window_summary(attribution: DataFrame, label: str) -> DataFrame:
    """Distribution of one window's intensities, contribution sums and volatility shares."""
    flows = ("borrow", "repay", "liquidate", "withdraw", "supply")
    columns = [f"{f}_intensity_{label}" for f in (*flows, "interest")]
    columns += [f"{f}_intensity_norm_supply_{label}" for f in ("borrow", "withdraw", "repay")]
    columns += [f"contrib_{f}_sum_{label}" for f in flows]
    columns += [f"contrib_{f}_abs_sum_{label}" for f in ("withdraw", "repay", "liquidate")]
    columns += [f"vol_share_{f}_{label}" for f in flows]
    return describe(attribution, columns)


def value_ranges(attribution: DataFrame) -> DataFrame:
    """Range of utilization and APR."""
    return attribution.groupBy("market_id").agg(
        *[
            agg(c).alias(f"{name}_{c}")
            for c in ("utilization_rate", "borrow_apr")
            for name, agg in (("min", F.min), ("max", F.max))
        ]
    )


def quality_summary(attribution: DataFrame) -> DataFrame:
    """Nulls, bounds, residual distribution and the flow identity, one row per market."""
    u, residual = F.col("utilization_rate"), F.abs("delta_u_residual")
    off = F.abs(
        F.expr("borrow_in_assets - repay_out_assets - liquidate_repay_assets + interest_assets")
        - F.col("delta_borrow_assets").cast("double")
    )
    integers = ["delta_supply_assets", "delta_borrow_assets", "total_supplied_assets", "outstanding_borrow_assets"]
    rows = settled(attribution.select("market_id", *integers, "utilization_rate", residual.alias("residual"), off.alias("off")))
    residual, off = F.col("residual"), F.col("off")
    basic = rows.groupBy("market_id").agg(
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in integers],
        F.min(u).alias("min_utilization"),
        F.max(u).alias("max_utilization"),
        F.count_if((u < 0) | (u > 1)).alias("out_of_bounds"),
        F.count_if(residual > 0.01).alias("large_residuals"),
        F.max(off).alias("max_flow_diff"),
        F.avg(off).alias("mean_flow_diff"),
        F.count_if(off > 1.0).alias("flow_diffs"),
    )
    sizes = describe(rows, ["residual"], probabilities=(0.5, 0.95), ready=True).select(
        "market_id",
        F.col("mean").alias("mean_residual"), F.col("p50").alias("median_residual"),
        F.col("p95").alias("p95_residual"), F.col("max").alias("max_residual"),
    )
    return basic.join(sizes, "market_id")
