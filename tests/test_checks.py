import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import ledgers
from poolscope.operators import checks, reports
from poolscope.operators.attribution import attribution_core
from poolscope.operators.quantiles import describe, quantiles
from poolscope.operators.state import enriched_ledger, state_frame
from poolscope.operators.standardize import raw_ledger


def test_schema_contracts(spark):
    raw = ledgers.to_spark(spark, ledgers.raw(rows=20))
    checks.require_raw_ledger(raw)
    with pytest.raises(ValueError, match="order"):
        checks.require_raw_ledger(raw.select(*reversed(raw.columns)))
    with pytest.raises(ValueError, match="missing"):
        checks.require_ledger(raw)
    with pytest.raises(ValueError, match="extra"):
        checks.require_raw_ledger(raw.withColumn("more", F.lit(1)))
    checks.require_ledger(enriched_ledger(raw).withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        checks.require_event(raw, "Supply")


def test_value_contracts(spark):
    df = spark.createDataFrame([(1, 0.5, "x"), (None, 1.2, "y")], "n bigint, u double, s string")
    with pytest.raises(KeyError):
        checks.require_integers(df, ["absent"], context="t")
    with pytest.raises(TypeError):
        checks.require_integers(df, ["s"], context="t")
    with pytest.raises(ValueError, match="not set"):
        checks.require_integers(df, ["n"], context="t")
    checks.require_integers(df.where("n = 1"), ["n"], context="t")
    with pytest.raises(ValueError, match="beyond a share"):
        checks.require_utilization(df, column="u", context="t")
    with pytest.raises(ValueError, match="have no"):
        checks.require_utilization(df.selectExpr("double('nan') AS u"), column="u", context="t")
    with pytest.raises(KeyError):
        checks.require_utilization(df, context="t")
    checks.require_utilization(df.where("n = 1"), column="u", context="t")


def test_integrity_errors_and_warnings(spark):
    core = attribution_core(state_frame(ledgers.to_spark(spark, ledgers.raw(rows=60, markets=1))))
    assert checks.passed(checks.integrity_report(core)).first().passed
    broken = core.withColumns({
        "utilization_rate": F.when(F.col("log_index") == 6, 1.5).otherwise(F.col("utilization_rate")),
        "borrow_in_assets": F.col("borrow_in_assets") + F.when(F.col("log_index") < 9, 5.0).otherwise(0.0),
        "delta_supply_assets": F.when(F.col("event_type") == "AccrueInterest", F.col("delta_supply_assets") * 2)
        .otherwise(F.col("delta_supply_assets")),
    })
    rows = {r["check"]: r for r in checks.integrity_report(broken, max_residual_abs=1e-9).collect()}
    assert rows["utilization_bounds"].violations == 1 and rows["utilization_bounds"].max_value == 1.5
    assert rows["flow_identity"].violations == 3 and rows["flow_identity"].max_value == 5
    assert not rows["interest_equals_supply_delta"].passed and rows["interest_equals_borrow_delta"].passed
    assert not rows["residual_size"].passed
    verdict = checks.passed(checks.integrity_report(broken)).first()
    assert not verdict.passed and verdict.errors == ["flow_identity", "utilization_bounds"]


def test_timestamp_order(spark):
    frame = ledgers.raw(rows=30, markets=1, steps=(12,))
    frame.loc[10, "block_timestamp"] -= 100
    frame.loc[21, "block_number"] = frame.loc[20, "block_number"]
    row = checks.timestamp_order(ledgers.to_spark(spark, frame)).first()
    assert (row.rows, row.backward_rows, row.split_blocks) == (30, 1, 1)
    assert checks.timestamp_order(raw_ledger({}, spark=spark)).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-18, 6, 500), np.zeros(300), -np.zeros(10),
                             np.full(200, 0.25), 2.0 ** np.arange(-20, 20)])
    frame = pd.DataFrame({"g": ["a", "b"] * (len(values) // 2), "v": values[: len(values) // 2 * 2]})
    df = spark.createDataFrame(frame)
    probabilities = [0, 0.05, 0.25, 0.5, 0.77, 0.95, 1]
    got = quantiles(df, "v", probabilities, part=["g"]).toPandas().set_index("g")
    for g, group in frame.groupby("g"):
        for p in probabilities:
            assert got.loc[g, f"p{100 * p:g}"] == pytest.approx(group.v.quantile(p), rel=1e-12, abs=0)
    both = describe(df.withColumn("w", F.col("v") * 2), ["v", "w"], part=["g"]).toPandas().set_index(["g", "metric"])
    expected = frame[frame.g == "a"].v.describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p50", "50%"), ("max", "max")):
        assert both.loc[("a", "v"), ours] == pytest.approx(expected[theirs], rel=1e-12)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_quantiles_of_hot_values_and_narrow_ranges(spark, broadcast):
    """A third of all rows hold one value; another part's values differ in the last bits only; ranks fall between buckets."""
    rng = np.random.default_rng(1)
    parts = {"hot": np.concatenate([np.full(300, 2.5), rng.normal(size=600)]), "bits": 1 + np.arange(400) * 2.0**-52,
             "gap": np.array([-1e300, 1e-301, 3.0, 1e12]), "one": np.array([-7.0]), "two": np.array([np.nan, 4.0])}
    frame = pd.DataFrame([(g, float(v)) for g, values in parts.items() for v in values], columns=["g", "v"])
    df = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).repartition(3)
    probabilities = [0.01, 0.25, 0.5, 0.9]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = quantiles(df, "v", probabilities, part=["g"]).toPandas().set_index("g")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got.index) == set(parts)
    for g, group in frame.groupby("g"):
        for p in probabilities:
            assert got.loc[g, f"p{100 * p:g}"] == pytest.approx(group.v.quantile(p), rel=1e-15, abs=0)
    assert quantiles(df.limit(0), "v", [0.5], part=["g"]).count() == 0


def test_reports(spark):
    frame = ledgers.raw()
    state = state_frame(ledgers.to_spark(spark, frame))
    full = ledgers.enriched(frame)
    last = full.groupby("market_id").tail(1).set_index("market_id")
    for r in reports.latest_state(state).collect():
        assert r.utilization_rate == pytest.approx(last.loc[r.market_id].utilization_rate)
    ages = reports.latest_rows(state, ["tx_hash"], 3).orderBy("market_id", "age").collect()
    assert [r.tx_hash for r in ages[:3]] == full[full.market_id == "m0"].tx_hash.tolist()[:-4:-1]
    summary = reports.event_type_summary(state).collect()
    assert [r.event_count for r in summary] == sorted((r.event_count for r in summary), reverse=True)
    assert reports.time_series(state, 7).count() == 7
    first = reports.ordered(state).first()
    assert (first.market_id, first.log_index) == ("m0", 0)
    core = attribution_core(state)
    moves = reports.significant_moves(core, threshold=0.01).count()
    assert moves == sum((g.utilization_rate.diff().abs() > 0.01).sum() for _, g in full.groupby("market_id"))
