import numpy as np
import pandas as pd
import pytest

import ledgers
from poolscope.operators import checks
from poolscope.operators.attribution import attribution, attribution_core, chosen_windows
from poolscope.operators.state import enriched_ledger, state_frame
from poolscope.operators.ticks import tick_ledger
from poolscope.plans.pipelines import attribution_dataset
from poolscope.schemas import ATTRIBUTION_CORE, ATTRIBUTION_WINDOWS

FLOWS = {"borrow_in_assets": ("Borrow", "delta_borrow_assets", 1), "repay_out_assets": ("Repay", "delta_borrow_assets", -1),
         "liquidate_repay_assets": ("Liquidate", "delta_borrow_assets", -1), "supply_in_assets": ("Supply", "delta_supply_assets", 1),
         "withdraw_out_assets": ("Withdraw", "delta_supply_assets", -1), "interest_assets": ("AccrueInterest", "delta_borrow_assets", 1)}


def by_pandas(full, windows):
    out = []
    for _, g in full.groupby("market_id"):
        g = g.copy()
        g["borrow_apr"] = g.borrow_rate_per_sec * ledgers.YEAR
        g["buffer"] = (1 - g.utilization_rate).clip(lower=0)
        for share, name in ((0.9, "90"), (0.95, "95")):
            g[f"headroom_u{name}_assets"] = np.trunc(share * g.total_supplied_assets - g.outstanding_borrow_assets)
        for f, (kind, col, sign) in FLOWS.items():
            g[f] = np.where(g.event_type == kind, sign * g[col], 0).astype(float)
        g["net_borrow_principal_assets"] = g.borrow_in_assets - g.repay_out_assets - g.liquidate_repay_assets
        g["net_supply_assets"] = g.supply_in_assets - g.withdraw_out_assets
        base = np.maximum(g.total_supplied_assets.shift(1).fillna(0), 1.0)
        used = g.utilization_rate.shift(1).fillna(0)
        parts = {"borrow": g.borrow_in_assets / base, "repay": -g.repay_out_assets / base,
                 "liquidate": -g.liquidate_repay_assets / base, "withdraw": used * g.withdraw_out_assets / base,
                 "supply": -used * g.supply_in_assets / base, "interest": g.interest_assets / base * (1 - used)}
        for n, p in parts.items():
            g[f"contrib_u_from_{n}"] = p
        g["delta_u_pred"] = sum(parts.values())
        g["delta_u_real"] = g.utilization_rate.diff().fillna(0)
        g["delta_u_residual"] = g.delta_u_real - g.delta_u_pred
        g["delta_borrow_apr"] = g.borrow_apr.diff().fillna(0)
        g["irm_slope"] = g.delta_borrow_apr / g.delta_u_real.where(g.delta_u_real.abs() > 1e-9)
        slope = g.irm_slope.clip(-1000, 1000).fillna(0)
        for n in ("withdraw", "repay", "liquidate"):
            g[f"irm_response_to_{n}"] = g.delta_borrow_apr / parts[n].where(parts[n].abs() > 1e-12)
        time = pd.to_datetime(g.block_timestamp, unit="s")
        for label, w in windows.items():
            series = lambda s: pd.Series(np.asarray(s, float), index=time)
            roll = lambda s, k=1: series(s).rolling(f"{w}s", min_periods=k) if w else series(s).expanding(k)
            put = lambda name, s: g.__setitem__(f"{name}_{label}", np.asarray(s, float))
            for c, stem in (("utilization_rate", "util"), ("borrow_apr", "borrow_apr")):
                put(f"{stem}_mean", roll(g[c]).mean()), put(f"{stem}_max", roll(g[c]).max())
                put(f"{stem}_std", roll(g[c], 2).std().fillna(0))
            put("delta_u_std", roll(g.delta_u_real, 2).std().fillna(0))
            if w is None:
                continue
            put("buffer_min", roll(g.buffer).min())
            mean_supply = np.maximum(roll(g.total_supplied_assets).mean(), 1)
            for f in FLOWS:
                n = f.split("_")[0]
                put(f"{n}_intensity", roll(g[f]).sum() / w)
                if n in ("borrow", "withdraw", "repay"):
                    put(f"{n}_intensity_norm_supply", roll(g[f]).sum() / w / mean_supply)
            variance = np.maximum(roll(g.delta_u_real, 2).var().fillna(0), 1e-12)
            for n in ("withdraw", "repay", "liquidate", "borrow", "supply"):
                put(f"contrib_{n}_sum", roll(parts[n]).sum())
                put(f"vol_share_{n}", roll(parts[n], 2).cov(series(g.delta_u_real)).fillna(0) / variance)
            for n in ("withdraw", "repay", "liquidate"):
                put(f"contrib_{n}_abs_sum", roll(parts[n].abs()).sum())
            put("irm_slope_std", roll(slope, 2).std().fillna(0))
        out.append(g)
    return pd.concat(out, ignore_index=True)


def without_first_outlier(frame):
    """A first Supply, so that pandas' online covariance is not swamped by a raw first-row amount."""
    frame = frame.copy()
    first = frame.groupby("market_id").head(1).index
    frame.loc[first, ["event_type", "delta_supply_assets", "delta_borrow_assets"]] = ["Supply", 50_000, 0]
    return frame


def numbers(df):
    return [c for c in df.columns if c not in ("market_id", "tx_hash", "event_type")]


@pytest.mark.parametrize("adjacent", [True, False])
def test_attribution_matches_plain_statement(spark, adjacent):
    frame = without_first_outlier(ledgers.raw(seed=2))
    raw = ledgers.to_spark(spark, frame)
    windows = {"5min": 300, "24h": 86_400, "7d": 604_800, "expanding": None}
    df = attribution(state_frame(raw) if adjacent else enriched_ledger(raw), compute_windows=["7d", "5min", "24h"])
    checks.require_attribution(df)
    assert df.columns[:46] == ATTRIBUTION_CORE.names and len(df.columns) == 46 + 3 * 31 + 7
    got = ledgers.collected(df)
    expected = by_pandas(ledgers.enriched(frame), windows)
    loose = [c for c in numbers(got) if "vol_share" in c or "std" in c]
    ledgers.assert_columns(got, expected, [c for c in numbers(got) if c not in loose], tol=1e-9)
    ledgers.assert_columns(got, expected, loose, tol=1e-5)


def test_window_wider_than_the_data_is_expanding(spark):
    df = attribution(state_frame(ledgers.to_spark(spark, ledgers.raw(rows=80))), compute_windows=["365d"])
    got = ledgers.collected(df)
    for stem in ("util_mean", "util_std", "util_max", "borrow_apr_mean", "borrow_apr_std", "delta_u_std"):
        assert np.allclose(got[f"{stem}_365d"], got[f"{stem}_expanding"], atol=1e-12, equal_nan=True)


def test_first_row_borrow_contributes_its_amount_and_is_flagged(spark):
    frame = ledgers.raw(rows=30, markets=1)
    core = attribution_core(state_frame(ledgers.to_spark(spark, frame)))
    first = ledgers.collected(core).iloc[0]
    assert first.event_type == "Borrow" and first.contrib_u_from_borrow == first.delta_borrow_assets
    assert abs(first.delta_u_residual) > 0.01


def test_ticks_keep_their_flows(spark):
    ledger = enriched_ledger(ledgers.to_spark(spark, ledgers.raw(rows=120)))
    ticks = tick_ledger(ledger)
    core = attribution_core(ticks)
    assert core.count() == ticks.count()
    sums = lambda df: df.groupBy().sum("borrow_in_assets", "repay_out_assets", "interest_assets").first()
    assert [float(x) for x in sums(ticks)] == list(sums(core))
    assert checks.integrity_report(core).where("check = 'flow_identity' AND NOT passed").count() == 0


def test_first_last_only(spark):
    frame = ledgers.raw(rows=400)
    ledger = enriched_ledger(ledgers.to_spark(spark, frame))
    full = ledgers.enriched(frame)
    groups = full.groupby(["market_id", full.block_timestamp // 300])
    thin = full.loc[groups.head(1).index.union(groups.tail(1).index)].reset_index(drop=True)
    got = ledgers.collected(attribution_core(ledger, first_last_only=True))
    expected = by_pandas(thin, {})
    ledgers.assert_columns(got, expected, ["delta_u_real", "delta_u_pred", "delta_u_residual", "delta_borrow_apr"])


def test_window_choice():
    assert list(chosen_windows()) == list(ATTRIBUTION_WINDOWS)
    assert list(chosen_windows(None, ["24h", "5min"])) == ["5min", "24h"]
    with pytest.raises(KeyError):
        chosen_windows(None, ["2h"])


def test_dataset_needs_an_input(spark):
    with pytest.raises(ValueError):
        attribution_dataset()
    ledger = enriched_ledger(ledgers.to_spark(spark, ledgers.raw(rows=40)))
    table, report = attribution_dataset(ledger=ledger, compute_windows=["1h"])
    assert report.count() == 14 and "util_mean_1h" in table.columns
    assert attribution_dataset(ledger=ledger, compute_windows=[], validate=False)[1] is None
