"""Options that reach every step, wide amounts, time order, and who deletes settled tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

import ledgers
from poolscope.operators import checks
from poolscope.operators.attribution import attribution_core
from poolscope.operators.state import state_frame
from poolscope.plans import pipelines
from poolscope.schemas import WIDE
from poolscope.session import settled, settling, shared_folder
from poolscope.sources.events import EventStore


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """One market: supply, interest, borrow, each 2^70 base units."""
    root = str(tmp_path_factory.mktemp("wide"))
    amount = hex(2**70)
    for k, (event, extra) in enumerate((("Supply", (amount,)), ("AccrueInterest", ("3000000000", amount)), ("Borrow", (amount,)))):
        names = "id string, block_number long, log_index long, block_timestamp long, tx_hash string, "
        kind = "prevBorrowRate string, interest string" if event == "AccrueInterest" else "assets string"
        spark.createDataFrame([("m", 10 + k, k, 1000 + 12 * k, f"t{k}", *extra)], names + kind).write.parquet(f"{root}/market/shards/{event}/shard_0.parquet")
    return EventStore(spark, root, layout="market/shards/{event}/shard_0.parquet/*.parquet")


def test_options_reach_every_step(store):
    year = 31_557_600
    options = {"seconds_per_year": year, "leading_rate": "zero", "amount_type": WIDE}
    table, report = pipelines.attribution_dataset(store, compute_windows=["1h"], **options)
    for df in (table, pipelines.indicator_dataset(store, **options)):
        assert dict(df.dtypes)["total_supplied_assets"] == WIDE
        rows = df.orderBy("block_number").collect()
        assert [int(r["total_supplied_assets"]) for r in rows] == [2**70, 2**71, 2**71]
        assert [r["borrow_apr"] for r in rows] == pytest.approx([0.0, 3e-9 * year, 3e-9 * year])
        assert rows[2]["borrow_apy"] == pytest.approx(math.expm1(rows[2]["borrow_apr"]), rel=1e-9)
    assert report.where("NOT passed AND severity = 'error'").count() == 0
    for level in ("tick", "block"):
        ticks = pipelines.tick_dataset(store, aggregation_level=level, **options)
        assert dict(ticks.dtypes)["supply_in_assets"] == WIDE
        assert int(ticks.agg(F.sum("supply_in_assets")).first()[0]) == 2**70
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        pipelines.enriched_ledger_dataset(store).collect()


def test_time_order_is_an_error(spark):
    ledger = state_frame(ledgers.to_spark(spark, ledgers.raw(rows=30)))
    assert checks.require_time_order(ledger) is ledger
    late = ledger.withColumn("block_timestamp", F.col("block_timestamp") - F.when(F.col("log_index") == 30, 10_000).otherwise(0))
    report = checks.integrity_report(attribution_core(late)).where("check = 'timestamp_order'").orderBy("market_id").collect()
    assert [r["passed"] for r in report] == [False, True] and report[0]["violations"] >= 1
    with pytest.raises(ValueError, match="ledger order"):
        pipelines.attribution_dataset(ledger=late, refuse_unordered=True)


def test_settled_tables_have_an_owner(spark):
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with settling(spark):
        kept = settled(spark.range(5))
        with settling(spark):
            assert settled(spark.range(3)).count() == 3
        assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert {x for x in os.listdir(folder) if x.startswith("settled-")} <= before
