import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import ledgers
from poolscope.operators.state import enriched_ledger
from poolscope.operators.ticks import aggregate_ledger, block_ledger, first_last_per_tick, tick_ledger
from poolscope.schemas import AGGREGATED_LEDGER, FLOW_TOTALS


def small(spark, rows):
    """(market, block, log, seconds, event, supply delta, borrow delta)"""
    frame = pd.DataFrame(rows, columns=["market_id", "block_number", "log_index", "block_timestamp", "event_type",
                                        "delta_supply_assets", "delta_borrow_assets"])
    frame["tx_hash"], frame["delta_collateral_assets"] = "h" + frame.log_index.astype(str), 0
    frame["borrow_rate_per_sec"] = np.where(frame.event_type == "AccrueInterest", 1e-9, np.nan)
    return enriched_ledger(ledgers.to_spark(spark, frame))


ROWS = [
    ("a", 1, 1, 1000, "Supply", 100, 0), ("a", 1, 2, 1000, "Borrow", 0, 60), ("a", 2, 3, 1110, "Withdraw", -40, 0),
    ("a", 5, 4, 1450, "Repay", 0, -10), ("b", 9, 5, 90_000, "Supply", 5, 0),
]


def test_gap_fill_last_and_running_max(spark):
    ledger = small(spark, ROWS)
    last = ledgers.collected(tick_ledger(ledger, tick_seconds=100), ("market_id", "block_timestamp"))
    a = last[last.market_id == "a"]
    assert a.block_timestamp.tolist() == [1000, 1110, 1300, 1400, 1450]
    assert a.total_supplied_assets.tolist() == [100, 60, 60, 60, 60]
    assert a.event_count.tolist() == [2, 1, 0, 0, 1]
    assert a.delta_supply_assets.tolist() == [100, -40, 0, 0, 0]
    assert np.allclose(a.delta_utilization, [0, 0.4, 0, 0, -10 / 60])
    top = ledgers.collected(tick_ledger(ledger, tick_seconds=100, fill="running_max"), ("market_id", "block_timestamp"))
    a = top[top.market_id == "a"]
    assert a.total_supplied_assets.tolist() == [100, 60, 100, 100, 60]
    assert a.block_number.tolist() == [1, 2, 2, 2, 5]
    assert len(last[last.market_id == "b"]) == 1
    assert list(last.columns) == AGGREGATED_LEDGER.names


def test_long_gap_unfolds_completely(spark):
    ledger = small(spark, [("a", 1, 1, 0, "Supply", 10, 0), ("a", 2, 2, 50_000, "Supply", 1, 0)])
    ticks = tick_ledger(ledger, tick_seconds=5)
    assert ticks.count() == 10_001
    assert ticks.where("event_count = 0 AND total_supplied_assets = 10").count() == 9_999
    assert ticks.where("event_count = 0").select("block_timestamp").distinct().count() == 9_999


def test_sums_agree_between_events_ticks_and_blocks(spark):
    ledger = enriched_ledger(ledgers.to_spark(spark, ledgers.raw()))
    ticks, blocks = aggregate_ledger(ledger), aggregate_ledger(ledger, aggregation_level="block")
    sums = [f"sum({c})" for c in ("delta_supply_assets", "delta_borrow_assets", "delta_collateral_assets", *FLOW_TOTALS, "event_count")]
    total = lambda df: sorted(map(tuple, df.groupBy("market_id").agg(*[F.expr(s) for s in sums]).collect()))
    assert total(ticks) == total(blocks)
    assert {r[0]: r[1] for r in ticks.groupBy("market_id").sum("delta_supply_assets").collect()} == {
        r[0]: r[1] for r in ledger.groupBy("market_id").sum("delta_supply_assets").collect()}
    with pytest.raises(ValueError):
        aggregate_ledger(ledger, aggregation_level="hour")
    with pytest.raises(ValueError):
        tick_ledger(ledger, fill="mean")


def test_block_changes(spark):
    frame = ledgers.raw()
    got = ledgers.collected(block_ledger(enriched_ledger(ledgers.to_spark(spark, frame))))
    ends = ledgers.enriched(frame).groupby(["market_id", "block_number"], as_index=False).last()
    ends["delta_utilization"] = ends.groupby("market_id").utilization_rate.diff().fillna(0)
    ledgers.assert_columns(got, ends, ["log_index", "utilization_rate", "delta_utilization", "total_supplied_assets"])


def test_first_last_per_tick(spark):
    frame = ledgers.raw()
    ledger = enriched_ledger(ledgers.to_spark(spark, frame))
    got = ledgers.collected(first_last_per_tick(ledger, tick_seconds=3600))
    full = ledgers.enriched(frame)
    groups = full.groupby(["market_id", full.block_timestamp // 3600])
    keep = groups.head(1).index.union(groups.tail(1).index)
    assert got.log_index.tolist() == full.loc[keep].log_index.tolist()
    plan = first_last_per_tick(ledger, tick_seconds=3600)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
