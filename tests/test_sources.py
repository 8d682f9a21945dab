import json

import pytest

from poolscope.operators.standardize import raw_ledger, raw_ledger_together
from poolscope.plans import pipelines
from poolscope.schemas import EVENTS, event_schema
from poolscope.sources.events import EventStore, register, write_features
from poolscope.sources.manifest import manifest_audit, read_manifest


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Shards in the fetcher's layout; two event kinds have none."""
    root = tmp_path_factory.mktemp("protocol")
    for k, event in enumerate(EVENTS):
        if event in ("Liquidate", "WithdrawCollateral"):
            continue
        rows = []
        for i in range(6):
            extra = ("1000000000", str(10 + i)) if event == "AccrueInterest" else (hex(100 + i),)
            rows.append((f"m{i % 3}", 10 + i, 100 * i + k, 1000 + 12 * i, f"t{k}{i}", *extra))
        frame = spark.createDataFrame(rows, event_schema(event)).toPandas()
        folder = root / "market" / "shards" / event
        folder.mkdir(parents=True)
        frame.iloc[:4].to_parquet(folder / "shard_0.parquet")
        frame.iloc[4:].to_parquet(folder / "shard_1.parquet")
        frame.to_parquet(folder / "other.parquet")
    return EventStore(spark, str(root))


def test_scan_filters_and_prunes(store):
    df = store.read("Supply", market_ids="m1", columns=["block_number", "assets"], extra_where="block_number > ?", extra_args=[11])
    assert [tuple(r) for r in df.collect()] == [(14, "0x68")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,m1)" in plan and "GreaterThan(block_number,11)" in plan and "tx_hash" not in plan
    assert store.read("Supply").count() == 6
    assert store.read("Supply", market_ids=["m0", "m2"]).count() == 4
    with pytest.raises(ValueError):
        store.path("Mint")


def test_missing_kinds_are_empty(store):
    assert store.read("Liquidate").count() == 0
    strict = EventStore(store.spark, store.root, allow_missing=False)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        strict.read("Liquidate")
    assert EventStore(store.spark, store.root + "/none").read_together().count() == 0


def test_one_scan_equals_eight(store):
    apart = raw_ledger(store.read_all("m1"))
    together = raw_ledger_together(store.read_together("m1"))
    assert apart.schema.names == together.schema.names
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))
    assert together.count() == 12
    plan = store.read_together(["m1"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(id,m1)" in plan


def test_pipelines_from_shards(store):
    ledger = pipelines.enriched_ledger_dataset(store)
    assert ledger.count() == 36
    assert pipelines.tick_dataset(store, "m0", aggregation_level="block").count() == 2
    table, report = pipelines.attribution_dataset(store, ["m0"], compute_windows=["5min"])
    assert table.count() == 12 and report.count() == 7
    assert pipelines.indicator_dataset(store, "m2").count() == 12


def test_sinks_and_views(spark, store, tmp_path):
    ledger = pipelines.enriched_ledger_dataset(store)
    register(ledger, "ledger_for_test")
    assert spark.sql("SELECT count(*) FROM ledger_for_test").first()[0] == 36
    write_features(ledger, str(tmp_path / "out"), by_market=True)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("market_id = 'm1'").count() == 12
    assert any(f.name.endswith(".snappy.parquet") for f in (tmp_path / "out" / "market_id=m1").iterdir())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_features(ledger, str(tmp_path / "out"))


def test_manifest_audit(spark, tmp_path):
    lines, ranges = [], [(1, 100, "failed"), (1, 50, "done"), (51, 100, "done"), (111, 120, "done")]
    for a, b, status in ranges:
        lines.append(dict(from_block=a, to_block=b, status="started", attempts=1))
        lines.append(dict(from_block=a, to_block=b, status=status, attempts=1, logs=5, shards=8, updated_at=1.5))
    (tmp_path / "run.jsonl").write_text("\n".join(map(json.dumps, lines)))
    row = manifest_audit(read_manifest(spark, str(tmp_path))).first()
    assert (row.run, row.started, row.done, row.failed) == ("run.jsonl", 4, 3, 1)
    assert (row.first_block, row.last_block, row.blocks, row.logs, row.shards, row.gaps) == (1, 120, 110, 15, 24, 1)
