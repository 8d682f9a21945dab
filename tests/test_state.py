import numpy as np
import pytest

import ledgers
from poolscope.operators.state import enriched_ledger, require_rows, state_frame, with_previous
from poolscope.operators.standardize import raw_ledger, standardize_event
from poolscope.schemas import EVENTS, LEDGER, RAW_LEDGER, event_schema

STATE = ["total_supplied_assets", "outstanding_borrow_assets", "total_collateral_assets", "borrow_rate_per_sec",
         "utilization_rate", "borrow_apy", "supply_rate_per_sec", "supply_apy", "delta_utilization",
         "delta_borrow_apy", "delta_supply_apy"]


@pytest.mark.parametrize("sizes", [{}, {"logs_per_cell": 2, "blocks_per_span": 3}, {"logs_per_cell": 7, "blocks_per_span": 1}])
def test_state_matches_plain_statement(spark, sizes):
    frame = ledgers.raw()
    got = ledgers.collected(enriched_ledger(ledgers.to_spark(spark, frame), **sizes))
    expected = ledgers.enriched(frame)
    assert list(got.columns) == LEDGER.names
    ledgers.assert_columns(got, expected, STATE, tol=1e-12)


def test_leading_rate_modes(spark):
    raw = ledgers.to_spark(spark, ledgers.raw(rows=40, markets=1))
    first = lambda df: ledgers.collected(df).iloc[0]
    assert np.isnan(first(enriched_ledger(raw)).borrow_apy)
    assert first(enriched_ledger(raw, leading_rate="zero")).borrow_apy == 0
    with pytest.raises(Exception, match="null before the first interest event"):
        enriched_ledger(raw, leading_rate="error").collect()
    with pytest.raises(ValueError):
        enriched_ledger(raw, leading_rate="other")


def test_previous_row_columns_agree_with_lag(spark):
    raw = ledgers.to_spark(spark, ledgers.raw())
    derived = ledgers.collected(state_frame(raw, logs_per_cell=4, blocks_per_span=5))
    lagged = ledgers.collected(with_previous(
        enriched_ledger(raw), {"s": "total_supplied_assets", "u": "utilization_rate", "r": "borrow_rate_per_sec"}))
    ledgers.assert_columns(derived.rename(columns={"_prev_supply": "s", "_prev_utilization": "u", "_prev_rate": "r"}),
                           lagged, ["s", "u", "r"], tol=0)
    assert (derived._first_row == lagged._first_row).all()


def test_empty_ledger(spark):
    empty = raw_ledger({}, spark=spark)
    assert empty.columns == RAW_LEDGER.names
    assert enriched_ledger(empty).count() == 0
    with pytest.raises(ValueError):
        require_rows(empty)


def test_standardize_signs_and_contract(spark):
    base = ("m", 1, 2, 3, "h")
    tables = {}
    for e in EVENTS:
        extra = ("2000000000", "10") if e == "AccrueInterest" else ("10",)
        tables[e] = spark.createDataFrame([(*base, *extra)], event_schema(e))
    rows = {r.event_type: r for r in raw_ledger(tables).collect()}
    deltas = lambda e: (rows[e].delta_supply_assets, rows[e].delta_borrow_assets, rows[e].delta_collateral_assets)
    assert {e: deltas(e) for e in EVENTS} == {
        "AccrueInterest": (10, 10, 0), "Borrow": (0, 10, 0), "Liquidate": (0, -10, 0), "Repay": (0, -10, 0),
        "Supply": (10, 0, 0), "SupplyCollateral": (0, 0, 10), "Withdraw": (-10, 0, 0), "WithdrawCollateral": (0, 0, -10)}
    assert rows["AccrueInterest"].borrow_rate_per_sec == 2e-9
    assert rows["Borrow"].borrow_rate_per_sec is None
    with pytest.raises(KeyError):
        standardize_event(tables["Supply"].drop("assets"), "Supply")
    with pytest.raises(ValueError):
        raw_ledger({"Mint": tables["Supply"]})
    integers = tables["Supply"].withColumn("assets", tables["Supply"].assets.cast("bigint"))
    assert standardize_event(integers, "Supply").first().delta_supply_assets == 10
    big = tables["Supply"].selectExpr("id", "block_number", "log_index", "block_timestamp", "tx_hash",
                                      "'0xffffffffffffffffffff' AS assets")
    wide = raw_ledger({"Supply": big, "Withdraw": tables["Withdraw"]}, amount_type="decimal(38,0)")
    from poolscope.operators.state import with_running_state
    assert with_running_state(wide).agg({"total_supplied_assets": "max"}).first()[0] == int("f" * 20, 16)


def test_logs_numbered_over_the_whole_ledger_share_cells(spark):
    frame = ledgers.raw(rows=64, markets=1).assign(block_number=1, block_timestamp=7, log_index=np.arange(64) * 65_536)
    got = state_frame(ledgers.to_spark(spark, frame))
    assert got.select("market_id", "block_number", "_cell").distinct().count() <= 4
    ledgers.assert_columns(ledgers.collected(got), ledgers.enriched(frame), STATE, tol=1e-12)
