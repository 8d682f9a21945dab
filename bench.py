"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run in full (all columns are computed, into a sink that discards them). A query's time
is the best of three runs, so that one-time code generation does not hide the work. The event tables
are written once before the clock starts, as they are the input.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from poolscope.operators import reports  # noqa: E402
from poolscope.operators.attribution import attribution, attribution_core  # noqa: E402
from poolscope.operators.checks import integrity_report  # noqa: E402
from poolscope.plans import pipelines as P  # noqa: E402
from poolscope.session import build_session, settled  # noqa: E402
from verify.fixture import event_store  # noqa: E402

QUERIES = {
    "enriched_ledger": P.enriched_ledger_dataset,
    "event_type_summary": lambda s: reports.event_type_summary(P.enriched_ledger_dataset(s)),
    "tick_ledger": P.tick_dataset,
    "block_ledger": lambda s: P.tick_dataset(s, aggregation_level="block"),
    "market_indicators": P.indicator_dataset,
    "attribution_core": lambda s: attribution_core(P.ledger_state(s)),
    "attribution_3_windows": lambda s: attribution(P.ledger_state(s), compute_windows=["5min", "1h", "24h"]),
    "attribution_8_windows": lambda s: attribution(P.ledger_state(s)),
    "attribution_of_ticks": lambda s: attribution(settled(P.tick_dataset(s)), compute_windows=["1h", "24h"]),
    "integrity_report": lambda s: integrity_report(attribution_core(P.ledger_state(s))),
    "residual_summary": lambda s: reports.residual_summary(attribution_core(P.ledger_state(s))),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app="poolscope-bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    store = event_store(spark, folder)
    times = {}
    for name, query in QUERIES.items():
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            query(store).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: {' '.join(f'{r:.2f}' for r in runs)}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf")),
    }))


if __name__ == "__main__":
    main()
