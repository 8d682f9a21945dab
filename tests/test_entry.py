"""The driver contract, and the plans' shape."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as driver
from verify.compare import differences
from verify.fixture import event_store
from verify.queries import registered
from poolscope.plans import pipelines

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_every_query_has_a_twin():
    own = {name for name in driver.queries() if name in registered()}
    assert own == set(registered()) and own <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(own) >= 45


def test_entry(spark):
    assert driver.entry(spark).count() == 16


@pytest.mark.parametrize("name", ["enriched_ledger", "tick_ledger_running_max", "market_indicators", "vol_share",
                                  "attr_long_windows", "integrity_report", "residual_summary"])
def test_query_equals_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert differences(got, con.execute(driver.oracle_sql()[name]).df()) == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_never_grouped_by_market_alone(spark):
    """Row-level exchanges carry the block; only span totals may meet per market."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(pipelines.indicator_dataset(event_store(spark, FOLDER)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    by_market = [e for e in exchanges if not re.search(r"block_number|_span|q#", e)]
    # The prefix over span totals, once per use of the state.
    assert all(e.startswith("market_id") for e in by_market) and len(by_market) <= 4
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_rows_are_shuffled_once_from_scan_to_windows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [_plan(pipelines.indicator_dataset(event_store(spark, FOLDER))),
                 _plan(pipelines.attribution_dataset(event_store(spark, FOLDER), compute_windows=["1h"])[0])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        # The plan's first branch is the rows' own path, down to the first scan.
        rows = plan[: plan.index("FileScan")]
        assert rows.count("Exchange hashpartitioning") == 1 and rows.count("SortMergeJoin") == 2


def test_ledger_queries_keep_methods_small_enough_to_be_compiled(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        spark.conf.unset(limit)
        event_store(spark, FOLDER)
        assert int(spark.conf.get(limit)) <= 8_000
        spark.conf.set(limit, "4000")
        event_store(spark, FOLDER)
        assert spark.conf.get(limit) == "4000"
    finally:
        spark.conf.set(limit, before)


def test_doubles_are_rounded_without_text_and_the_kind_is_found_once(spark):
    plan = _plan(driver.queries()["contributions"](spark, FOLDER))
    assert "rint(" in plan and " round(" not in plan
    scans = _plan(event_store(spark, FOLDER).read_together())
    assert scans.count("substring_index(substring_index(") == 2  # in the kind and in its length
    for digits in (8, 12, 18):
        values = [0.0, -0.1, 1 / 3, 2e-9, -123456.789, 3.5e15, 1e-13, float("nan"), None]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [r[0] for r in df.selectExpr(f"CAST(CAST(rint(v * 1e{digits}D) / 1e{digits}D AS FLOAT) AS DOUBLE) + 0D").collect()]
        con = duckdb.connect()
        want = [con.execute(f"SELECT CAST(CAST(round(?::DOUBLE, {digits}) AS FLOAT) AS DOUBLE) + 0.0::DOUBLE", [v]).fetchone()[0] for v in values]
        assert repr(got) == repr(want)
