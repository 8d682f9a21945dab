import numpy as np
import pandas as pd

import ledgers
from poolscope.operators.checks import require_indicators
from poolscope.operators.indicators import market_indicators
from poolscope.operators.state import enriched_ledger, state_frame
from poolscope.schemas import INDICATOR_WINDOWS, indicator_schema


def by_pandas(frame):
    out = []
    for _, g in ledgers.enriched(frame).groupby("market_id"):
        g = g.copy()
        g["borrow_apr"] = g.borrow_rate_per_sec * ledgers.YEAR
        db, ds = g.delta_borrow_assets, g.delta_supply_assets
        flows = {"borrow": db.clip(lower=0), "repay": (-db).clip(lower=0), "supply": ds.clip(lower=0), "withdraw": (-ds).clip(lower=0)}
        interest = db.where(g.event_type == "AccrueInterest", 0).astype(float)
        g["borrow_in_assets"], g["borrow_out_assets"] = flows["borrow"], flows["repay"]
        g["supply_in_assets"], g["supply_out_assets"] = flows["supply"], flows["withdraw"]
        g["interest_assets"] = interest
        time = pd.to_datetime(g.block_timestamp, unit="s")
        roll = lambda s, w, k=1: pd.Series(s.to_numpy(float), index=time).rolling(f"{w}s", min_periods=k)
        for n, w in INDICATOR_WINDOWS.items():
            for c, stem in (("utilization_rate", "util"), ("borrow_apr", "borrow_apr")):
                g[f"{stem}_mean_{n}"] = roll(g[c], w).mean().to_numpy()
                g[f"{stem}_std_{n}"] = roll(g[c], w, 2).std().fillna(0).to_numpy()
            for f, s in flows.items():
                g[f"{f}_intensity_{n}"] = roll(s, w).sum().to_numpy() / w
            lent, paid = roll(g.outstanding_borrow_assets, w).mean().to_numpy(), roll(interest, w).sum().to_numpy()
            g[f"interest_intensity_{n}"] = np.where(lent > 0, paid / np.where(lent > 0, lent, 1), 0)
        g["delta_borrow_apr"] = g.borrow_apr.diff().fillna(0)
        du = g.utilization_rate.diff().fillna(0)
        g["elasticity_apr_per_util"] = np.where(du.abs() > 1e-9, g.delta_borrow_apr / du.where(du.abs() > 1e-9, 1), 0)
        for p in (90, 95, 99):
            g[f"regime_util_gt_{p}"] = (g.utilization_rate > p / 100).astype(int)
        g["borrow_apr_6h_avg_ui"] = g["borrow_apr_mean_6h"]
        out.append(g)
    return pd.concat(out, ignore_index=True)


def test_indicators_match_plain_statement(spark):
    frame = ledgers.raw()
    raw = ledgers.to_spark(spark, frame)
    expected = by_pandas(frame)
    for source in (state_frame(raw), enriched_ledger(raw)):
        df = require_indicators(market_indicators(source))
        assert len(df.columns) == 59
        assert [f.dataType for f in df.schema] == [f.dataType for f in indicator_schema()]
        got = ledgers.collected(df)
        numbers = [c for c in got.columns if c not in ("market_id", "tx_hash", "event_type")]
        ledgers.assert_columns(got, expected, numbers, tol=1e-8)


def test_other_windows(spark):
    df = market_indicators(state_frame(ledgers.to_spark(spark, ledgers.raw(rows=50))), windows={"10min": 600})
    assert "util_mean_10min" in df.columns and "borrow_apr_6h_avg_ui" not in df.columns
    assert df.count() == 100
