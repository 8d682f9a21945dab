"""Small random ledgers and a plain pandas statement of what the pipeline should give for them."""

import numpy as np
import pandas as pd

SUPPLY = {"Supply": 1, "Withdraw": -1, "AccrueInterest": 1}
BORROW = {"Borrow": 1, "Repay": -1, "Liquidate": -1, "AccrueInterest": 1}
COLLATERAL = {"SupplyCollateral": 1, "WithdrawCollateral": -1}
YEAR = 31_536_000


def raw(rows=300, markets=2, seed=0, steps=(0, 0, 0, 12, 60, 700, 4000)):
    """Raw ledger rows with many ties in time, several logs per block, and a leading stretch without rate."""
    rng = np.random.default_rng(seed)
    parts = []
    for m in range(markets):
        move = rng.choice(steps, rows)
        ts = 1_700_000_000 + np.cumsum(move)
        block = 1_000 + np.cumsum(move > 0)
        kind = rng.choice(["Supply", "Borrow", "Withdraw", "Repay", "Liquidate", "AccrueInterest",
                           "SupplyCollateral", "WithdrawCollateral"], rows, p=[.3, .2, .1, .1, .05, .15, .05, .05])
        kind[:5] = ["Borrow", "Supply", "Supply", "Borrow", "Supply"]
        amount = rng.integers(1, 10_000, rows)
        parts.append(pd.DataFrame({
            "market_id": f"m{m}", "block_number": block, "log_index": np.arange(rows) * 3 + m,
            "block_timestamp": ts, "tx_hash": [f"t{m}_{i}" for i in range(rows)], "event_type": kind,
            "delta_supply_assets": [SUPPLY.get(k, 0) * a for k, a in zip(kind, amount)],
            "delta_borrow_assets": [BORROW.get(k, 0) * a for k, a in zip(kind, amount)],
            "delta_collateral_assets": [COLLATERAL.get(k, 0) * a for k, a in zip(kind, amount)],
            "borrow_rate_per_sec": np.where(kind == "AccrueInterest", rng.integers(1, 40, rows) * 1e-10, np.nan),
        }))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame):
    """Spark frame with NaN as null, in shuffled row order."""
    frame = frame.sample(frac=1, random_state=3)
    df = spark.createDataFrame(frame)
    exprs = [f"nanvl({c}, NULL) AS {c}" if frame[c].dtype == float else c for c in frame.columns]
    return df.selectExpr(*exprs)


def enriched(frame):
    out = []
    for _, g in frame.groupby("market_id"):
        g = g.sort_values(["block_number", "log_index"]).copy()
        for total, delta in (("total_supplied_assets", "delta_supply_assets"),
                             ("outstanding_borrow_assets", "delta_borrow_assets"),
                             ("total_collateral_assets", "delta_collateral_assets")):
            g[total] = g[delta].cumsum()
        g["borrow_rate_per_sec"] = g["borrow_rate_per_sec"].ffill()
        s, b = g.total_supplied_assets.astype(float), g.outstanding_borrow_assets.astype(float)
        g["utilization_rate"] = np.where(s > 0, np.clip(b / s.where(s > 0, 1), 0, 1), 0.0)
        g["borrow_apy"] = np.expm1(g.borrow_rate_per_sec * YEAR)
        g["supply_rate_per_sec"] = g.utilization_rate * g.borrow_rate_per_sec
        g["supply_apy"] = np.expm1(g.supply_rate_per_sec * YEAR)
        for d, c in (("delta_utilization", "utilization_rate"), ("delta_borrow_apy", "borrow_apy"),
                     ("delta_supply_apy", "supply_apy")):
            g[d] = g[c].diff()
            g.iloc[0, g.columns.get_loc(d)] = 0.0
        out.append(g)
    return pd.concat(out, ignore_index=True)


def collected(df, keys=("market_id", "block_number", "log_index")):
    return df.toPandas().sort_values(list(keys), ignore_index=True)


def assert_columns(got, expected, columns, tol=1e-9):
    for c in columns:
        a, b = got[c].to_numpy(float), expected[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        scale = 1.0 + np.abs(b[~np.isnan(b)])
        assert (np.abs(a - b)[~np.isnan(b)] <= tol * scale).all(), (c, np.nanmax(np.abs(a - b)))
