import numpy as np
import pandas as pd
import pytest

import ledgers
from poolscope.operators.rolling import Measures, block_width, rolling

WIDTHS = {"5min": 300, "1h": 3600, "100001s": 100_001, "7d": 604_800, "365d": 31_536_000, "expanding": None}


def statistics(w):
    n = w.label
    return [(f"mean_x_{n}", w.mean("x")), (f"std_x_{n}", w.std("x")), (f"sum_z_{n}", w.sum("z")), (f"mean_z_{n}", w.mean("z")),
            (f"max_x_{n}", w.max("x")), (f"min_z_{n}", w.min("z")), (f"cov_{n}", w.cov("y", "v")), (f"std_y_{n}", w.std("y")),
            (f"sum_y_{n}", w.sum("y"))]


MEASURES = Measures(levels=("x",), changes=("y", "v"), pairs=(("y", "v"),), sums=("z",), highs=("x",), lows=("z",),
                    nullable=frozenset({"x", "z"}))


def sample(rows=700, steps=(0, 0, 0, 10, 60, 4_000, 90_000)):
    rng = np.random.default_rng(5)
    frame = ledgers.raw(rows=rows, seed=5, steps=steps)[["market_id", "block_number", "log_index", "block_timestamp"]]
    n = len(frame)
    frame["x"] = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).cumsum())
    frame.loc[100:160, "x"] = 0.3
    frame["y"], frame["v"] = rng.normal(size=n), rng.normal(size=n)
    frame["z"] = np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n))
    return frame


def by_pandas(frame):
    out = []
    for _, g in frame.groupby("market_id"):
        g = g.sort_values(["block_number", "log_index"]).copy()
        g.index = pd.to_datetime(g.block_timestamp, unit="s")
        for n, w in WIDTHS.items():
            roll = lambda c, k=1: g[c].rolling(f"{w}s", min_periods=k) if w else g[c].expanding(k)
            g[f"mean_x_{n}"], g[f"std_x_{n}"] = roll("x").mean(), roll("x", 2).std().fillna(0)
            g[f"sum_z_{n}"], g[f"mean_z_{n}"] = roll("z").sum(), roll("z").mean()
            g[f"max_x_{n}"], g[f"min_z_{n}"] = roll("x").max(), roll("z").min()
            g[f"cov_{n}"] = roll("y", 2).cov(g.v).fillna(0)
            g[f"std_y_{n}"], g[f"sum_y_{n}"] = roll("y", 2).std().fillna(0), roll("y").sum()
        out.append(g)
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("options", [{"repeats": True}, {"repeats": False, "logs_per_cell": 2},
                                     {"repeats": False, "widest_block": 3_600}])
def test_windows_match_pandas(spark, options):
    frame = sample()
    got = ledgers.collected(rolling(ledgers.to_spark(spark, frame), MEASURES, WIDTHS, statistics, **options))
    expected = by_pandas(frame)
    ledgers.assert_columns(got, expected, [c for c in expected.columns if "_" in c and c not in frame.columns], tol=1e-8)


def test_rows_of_the_same_second_count_only_up_to_the_row(spark):
    frame = pd.DataFrame({"market_id": "m", "block_number": [1, 2, 2, 3, 4, 4], "log_index": range(6),
                          "block_timestamp": [0, 10, 10, 300, 310, 310], "y": [1., 2., 4., 8., 16., 32.]})
    df = rolling(ledgers.to_spark(spark, frame), Measures(changes=("y",)), {"w": 300}, lambda w: [("s", w.sum("y"))])
    assert ledgers.collected(df).s.tolist() == [1, 3, 7, 14, 24, 56]


def test_nulls_are_skipped_and_constants_have_no_spread(spark):
    frame = pd.DataFrame({"market_id": "m", "block_number": [1, 2, 3], "log_index": range(3),
                          "block_timestamp": [0, 1, 2], "z": [1., np.nan, 3.], "x": [0.1] * 3})
    m = Measures(sums=("z",), levels=("x",), nullable=frozenset({"z"}))
    got = ledgers.collected(rolling(ledgers.to_spark(spark, frame), m, {"w": 10}, lambda w: [("s", w.sum("z")), ("d", w.std("x"))]))
    assert got.s.tolist() == [1, 1, 4] and got.d.tolist() == [0, 0, 0]


def test_block_widths():
    assert block_width(300) == 300
    assert block_width(604_800) == 86_400
    assert 100_001 % block_width(100_001) == 0 and block_width(100_001) <= 86_400
    with pytest.raises(ValueError):
        block_width(0)


def test_measures_refuse_nullable_changes():
    with pytest.raises(ValueError):
        Measures(changes=("a",), nullable=frozenset({"a"}))


@pytest.mark.parametrize("options", [{"repeats": True}, {"repeats": False, "logs_per_cell": 2, "widest_block": 3_600}])
def test_pairs_of_levels_do_not_cancel(spark, options):
    frame = sample(rows=300)
    rng = np.random.default_rng(6)
    frame["x"], far = rng.normal(size=len(frame)).cumsum() + 1e9, rng.normal(size=len(frame))
    frame["u"] = 0.5 * (frame.x - 1e9) + far - 1e9
    near = frame.assign(x=frame.x - 1e9, u=frame.u + 1e9)
    widths = {"1h": 3600, "100001s": 100_001, "7d": 604_800, "expanding": None}
    measures = Measures(levels=("x", "u"), pairs=(("x", "u"),))
    outputs = lambda w: [(f"cov_{w.label}", w.cov("x", "u")), (f"var_{w.label}", w.var("x"))]
    got = ledgers.collected(rolling(ledgers.to_spark(spark, frame), measures, widths, outputs, **options))
    want = ledgers.collected(rolling(ledgers.to_spark(spark, near), measures, widths, outputs, **options))
    keys = ["market_id", "block_number", "log_index"]
    got, want = got.sort_values(keys), want.sort_values(keys)
    for name in [c for c in got if c.startswith(("cov_", "var_"))]:
        assert np.allclose(got[name], want[name], rtol=1e-6, atol=1e-6)
    plain = [g.x.expanding(2).cov(g.u).fillna(0) for _, g in near.sort_values(keys).groupby("market_id")]
    assert np.allclose(want.cov_expanding, np.concatenate(plain), rtol=1e-9, atol=1e-9)


def test_a_pair_is_of_one_kind():
    with pytest.raises(ValueError, match="two levels or two changes"):
        Measures(levels=("x",), changes=("y",), pairs=(("x", "y"),))
    with pytest.raises(ValueError, match="without nulls"):
        Measures(levels=("x", "y"), pairs=(("x", "y"),), nullable=frozenset({"x"}))
