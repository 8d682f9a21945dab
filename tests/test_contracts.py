"""Contracts as data, output order, and order of time by merged chunks."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import ledgers
from poolscope.operators import checks, contracts, reports
from poolscope.operators.standardize import raw_ledger
from poolscope.operators.state import enriched_ledger
from poolscope.schemas import EVENTS, LEDGER, event_schema
from poolscope.sources.events import write_ordered


@pytest.fixture(scope="module")
def ledger(spark):
    return enriched_ledger(ledgers.to_spark(spark, ledgers.raw(rows=300, seed=3)))


def found(df, rules):
    return {r["rule"]: r["violations"] for r in contracts.contract_report(df, rules).collect() if r["violations"]}


def test_report_names_each_broken_rule(ledger):
    assert found(ledger, contracts.ledger_contract(ledger)) == {}
    bad = ledger.withColumn("total_supplied_assets", F.when(F.col("log_index") % 7 > 0, F.col("total_supplied_assets")).cast("double"))
    bad = bad.withColumn("utilization_rate", F.when(F.col("log_index") % 5 == 0, float("nan")).otherwise(F.col("utilization_rate"))).drop("tx_hash")
    rows = [r["log_index"] for r in ledger.select("log_index").collect()]
    assert found(bad, contracts.ledger_contract(bad)) == {
        "missing_columns": 1, "not_whole_columns": 1, "null_total_supplied_assets": sum(i % 7 == 0 for i in rows),
        "bounds_utilization_rate": sum(i % 5 == 0 for i in rows)}
    extra = ledger.withColumn("more", F.lit(1))
    assert found(extra, contracts.contract(extra, LEDGER)) == {"extra_columns": 1}
    turned = ledger.select(*reversed(LEDGER.names))
    assert found(turned, contracts.contract(turned, LEDGER, in_order=True)) == {"misplaced_columns": 1}


def test_empty_tables_have_no_rows_but_a_schema(spark):
    tables = {e: spark.createDataFrame([], event_schema(e)) for e in EVENTS}
    empty = raw_ledger(tables)
    assert found(empty, contracts.raw_ledger_contract(empty)) == {"no_rows": 1}
    less = tables["Supply"].drop("assets")
    assert found(less, contracts.event_contract(less, "Supply")) == {"no_rows": 1, "missing_columns": 1}


def test_counts_are_seen_in_the_writing_pass(spark, ledger, tmp_path):
    bad = ledger.withColumn("market_id", F.when(F.col("log_index") % 11 > 0, F.col("market_id")))
    n = bad.where("market_id IS NULL").count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plain", "plain")
    bad.write.parquet(str(tmp_path / "plain"))
    spark.sparkContext.setJobGroup("checked", "checked")
    assert contracts.write_checked(bad, str(tmp_path / "out"), contracts.ledger_contract(bad)) == {"null_market_id": n}
    assert len(tracker.getJobIdsForGroup("checked")) == len(tracker.getJobIdsForGroup("plain"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == ledger.count()
    less = ledger.drop("tx_hash")
    with pytest.raises(ValueError, match="missing_columns"):
        contracts.write_checked(less, str(tmp_path / "less"), contracts.ledger_contract(less))
    none = ledger.limit(0)
    assert contracts.write_checked(none, str(tmp_path / "none"), contracts.ledger_contract(none)) == {"no_rows": 1}


def test_files_follow_each_other_in_order(ledger, tmp_path):
    write_ordered(ledger, str(tmp_path / "out"), files=5)
    key = ["market_id", "block_number", "log_index"]
    frames = [pq.read_table(f, columns=key).to_pandas() for f in sorted(glob.glob(str(tmp_path / "out" / "*.parquet")))]
    rows = [tuple(r) for f in frames for r in f.itertuples(index=False)]
    assert len(frames) >= 4 and rows == sorted(rows) and len(rows) == ledger.count()
    # The market with most rows lies in several files.
    assert max(sum((f.market_id == m).any() for f in frames) for m in {r[0] for r in rows}) >= 2


def test_positions_count_the_whole_order(ledger):
    got = reports.output_positions(ledger).select("block_number", "log_index", "market_id", "position").collect()
    rows = sorted(tuple(r)[:3] for r in got)
    assert {tuple(r)[:3]: r["position"] for r in got} == {r: k + 1 for k, r in enumerate(rows)}


def test_order_of_time_over_cells_and_spans(spark):
    rng = np.random.default_rng(2)
    rows, block = [], 0
    for i in range(400):
        block += int(rng.choice([0, 0, 1, 1, 5_000]))
        rows.append(("ab"[int(rng.random() < 0.3)], block, i * 40_000, 1_000 * block - (3_000_000 if rng.random() < 0.05 else 0)))
    frame = spark.createDataFrame(rows, "market_id string, block_number long, log_index long, block_timestamp long").repartition(6)
    got = {r["market_id"]: tuple(r)[1:] for r in checks.timestamp_order(frame).collect()}
    for m in "ab":
        own = sorted(r[1:] for r in rows if r[0] == m)
        times = {}
        for b, _, t in own:
            times.setdefault(b, set()).add(t)
        back = sum(x[2] > y[2] for x, y in zip(own, own[1:], strict=False))
        assert got[m] == (len(own), back, sum(len(t) > 1 for t in times.values())) and back > 0
