"""What keeps large ledgers cheap: events are parsed once, and logs numbered over the whole ledger make few cells."""

from poolscope.operators.attribution import attribution
from poolscope.operators.ordered import cell_of
from poolscope.plans import pipelines
from verify.fixture import event_store


def test_windows_parse_the_events_once(spark):
    """The plan scanned and parsed all events four times before: for rows and totals of the state, below rows and cells of the windows."""
    state = pipelines.ledger_state(event_store(spark, "/root/testdata/sf0.001"))
    table = attribution(state, compute_windows=["1h"], expanding=False)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "prevBorrowRate" not in plan
    assert "RLIKE" in pipelines.enriched_ledger_dataset(event_store(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()


def test_logs_numbered_over_the_whole_ledger_make_few_cells(spark):
    """Logs of a block 2 million apart lay in a cell each before, and a cell costs as much as many rows."""
    frame = spark.createDataFrame([(3,), (2_000_000,), (4_000_000,), (6_000_000,)], "log_index long")
    assert frame.select(cell_of().alias("c")).distinct().count() == 1
