"""DuckDB twins of the registered queries, written from the definitions and not from the Spark plans.

Windows are self-joins, gaps are filled against an explicit grid, amounts come from the integers.
"""

from __future__ import annotations

_EVENTS = """
ev AS (
  SELECT event_id, user_id % 2 AS m, epoch_us(ts) // 1000000 AS sec,
         CAST(round(value * 100) AS BIGINT) AS a, event_id % 8 AS k
  FROM events
),
amounts AS (
  SELECT 'm' || CAST(m AS VARCHAR) AS market_id, sec // 240 AS block_number, event_id AS log_index,
         sec // 240 * 240 AS block_timestamp, 't' || CAST(event_id AS VARCHAR) AS tx_hash,
         CASE k WHEN 0 THEN 'Supply' WHEN 1 THEN 'Borrow' WHEN 2 THEN 'Withdraw' WHEN 3 THEN 'Repay'
                WHEN 4 THEN 'Liquidate' WHEN 5 THEN 'AccrueInterest' WHEN 6 THEN 'SupplyCollateral'
                ELSE 'WithdrawCollateral' END AS event_type,
         a * CASE k WHEN 0 THEN 1000 WHEN 1 THEN CASE m WHEN 0 THEN 300 ELSE 550 END WHEN 2 THEN 400
                    WHEN 3 THEN 120 WHEN 4 THEN 60 WHEN 5 THEN 1 WHEN 6 THEN 500 ELSE 200 END AS amount,
         CASE WHEN k = 5 THEN CAST(1000000000 + 30000000 * (event_id % 50) AS DOUBLE) / 1e18 END AS rate
  FROM ev
),
raw AS (
  SELECT market_id, block_number, log_index, block_timestamp, tx_hash, event_type,
         CASE event_type WHEN 'Supply' THEN amount WHEN 'Withdraw' THEN -amount
                         WHEN 'AccrueInterest' THEN amount ELSE 0 END AS delta_supply_assets,
         CASE event_type WHEN 'Borrow' THEN amount WHEN 'Repay' THEN -amount WHEN 'Liquidate' THEN -amount
                         WHEN 'AccrueInterest' THEN amount ELSE 0 END AS delta_borrow_assets,
         CASE event_type WHEN 'SupplyCollateral' THEN amount WHEN 'WithdrawCollateral' THEN -amount
                         ELSE 0 END AS delta_collateral_assets,
         rate AS borrow_rate_per_sec
  FROM amounts
)"""

_STATE = """,
run AS (
  SELECT * EXCLUDE (borrow_rate_per_sec),
         row_number() OVER w AS rn,
         CAST(sum(delta_supply_assets) OVER w AS BIGINT) AS total_supplied_assets,
         CAST(sum(delta_borrow_assets) OVER w AS BIGINT) AS outstanding_borrow_assets,
         CAST(sum(delta_collateral_assets) OVER w AS BIGINT) AS total_collateral_assets,
         last_value(borrow_rate_per_sec IGNORE NULLS) OVER w AS borrow_rate_per_sec
  FROM raw
  WINDOW w AS (PARTITION BY market_id ORDER BY block_number, log_index
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
util AS (
  SELECT *, CASE WHEN total_supplied_assets > 0
                 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
                      CAST(outstanding_borrow_assets AS DOUBLE) / CAST(total_supplied_assets AS DOUBLE)))
                 ELSE 0.0::DOUBLE END AS utilization_rate
  FROM run
),
rates AS (
  SELECT *, exp(borrow_rate_per_sec * 31536000::DOUBLE) - 1 AS borrow_apy,
         utilization_rate * borrow_rate_per_sec AS supply_rate_per_sec,
         exp(utilization_rate * borrow_rate_per_sec * 31536000::DOUBLE) - 1 AS supply_apy
  FROM util
),
led AS (
  SELECT *,
    CASE WHEN rn = 1 THEN 0.0 ELSE utilization_rate - lag(utilization_rate) OVER o END AS delta_utilization,
    CASE WHEN rn = 1 THEN 0.0 ELSE borrow_apy - lag(borrow_apy) OVER o END AS delta_borrow_apy,
    CASE WHEN rn = 1 THEN 0.0 ELSE supply_apy - lag(supply_apy) OVER o END AS delta_supply_apy
  FROM rates WINDOW o AS (PARTITION BY market_id ORDER BY rn)
)"""

_FLOW_SUMS = """
    CAST(sum(delta_supply_assets) AS BIGINT) AS delta_supply_assets,
    CAST(sum(delta_borrow_assets) AS BIGINT) AS delta_borrow_assets,
    CAST(sum(delta_collateral_assets) AS BIGINT) AS delta_collateral_assets,
    CAST(coalesce(sum(delta_supply_assets) FILTER (WHERE event_type = 'Supply' AND delta_supply_assets > 0), 0) AS BIGINT) AS supply_in_assets,
    CAST(coalesce(-sum(delta_supply_assets) FILTER (WHERE event_type = 'Withdraw' AND delta_supply_assets < 0), 0) AS BIGINT) AS withdraw_out_assets,
    CAST(coalesce(sum(delta_borrow_assets) FILTER (WHERE event_type = 'Borrow' AND delta_borrow_assets > 0), 0) AS BIGINT) AS borrow_in_assets,
    CAST(coalesce(-sum(delta_borrow_assets) FILTER (WHERE event_type = 'Repay' AND delta_borrow_assets < 0), 0) AS BIGINT) AS repay_out_assets,
    CAST(coalesce(-sum(delta_borrow_assets) FILTER (WHERE event_type = 'Liquidate' AND delta_borrow_assets < 0), 0) AS BIGINT) AS liquidate_repay_assets,
    CAST(coalesce(sum(delta_borrow_assets) FILTER (WHERE event_type = 'AccrueInterest'), 0) AS BIGINT) AS interest_assets,
    CAST(coalesce(sum(delta_collateral_assets) FILTER (WHERE event_type = 'SupplyCollateral' AND delta_collateral_assets > 0), 0) AS BIGINT) AS collateral_in_assets,
    CAST(coalesce(-sum(delta_collateral_assets) FILTER (WHERE event_type = 'WithdrawCollateral' AND delta_collateral_assets < 0), 0) AS BIGINT) AS collateral_out_assets,
    count(*) AS event_count"""

_SUMMED = ["delta_supply_assets", "delta_borrow_assets", "delta_collateral_assets", "supply_in_assets",
           "withdraw_out_assets", "borrow_in_assets", "repay_out_assets", "liquidate_repay_assets",
           "interest_assets", "collateral_in_assets", "collateral_out_assets", "event_count"]
_LAST = ["block_number", "log_index", "tx_hash", "total_supplied_assets", "outstanding_borrow_assets",
         "total_collateral_assets", "borrow_rate_per_sec", "utilization_rate", "borrow_apy",
         "supply_rate_per_sec", "supply_apy"]


def _condensed(key: str, name: str) -> str:
    """Last row of each group by an explicit ranking, joined to the group's sums."""
    return f""",
pos AS (SELECT *, {key} AS grp, row_number() OVER (PARTITION BY market_id, {key} ORDER BY rn DESC) AS back FROM led),
ends AS (SELECT * FROM pos WHERE back = 1),
sums AS (SELECT market_id, grp, {_FLOW_SUMS} FROM pos GROUP BY market_id, grp),
{name} AS (
  SELECT s.market_id, s.grp, e.block_timestamp, {', '.join('e.' + c for c in _LAST)},
         {', '.join('s.' + c for c in _SUMMED)}
  FROM sums s JOIN ends e ON e.market_id = s.market_id AND e.grp = s.grp
)"""


def _changes(source: str, order: str) -> str:
    change = lambda c: f"CASE WHEN row_number() OVER o = 1 THEN 0.0 ELSE {c} - lag({c}) OVER o END"
    return f"""SELECT *, 'Aggregated' AS event_type, {change('utilization_rate')} AS delta_utilization,
       {change('borrow_apy')} AS delta_borrow_apy, {change('supply_apy')} AS delta_supply_apy
  FROM {source} WINDOW o AS (PARTITION BY market_id ORDER BY {order})"""


def _ticks(fill: str, seconds: int = 300) -> str:
    frame = "OVER (PARTITION BY g.market_id ORDER BY g.tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inherit = (
        (lambda c: f"last_value(t.{c} IGNORE NULLS) {frame}")
        if fill == "last"
        else (lambda c: f"coalesce(t.{c}, max(t.{c}) {frame})")
    )
    return (
        _condensed(f"block_timestamp // {seconds} * {seconds}", "tick_rows")
        + f""",
grid AS (
  SELECT market_id, unnest(range(min(grp), max(grp) + {seconds}, {seconds})) AS tick
  FROM tick_rows GROUP BY market_id
),
grid_filled AS (
  SELECT g.market_id, g.tick, coalesce(t.block_timestamp, g.tick + {seconds}) AS block_timestamp,
         {', '.join(f'{inherit(c)} AS {c}' for c in _LAST)},
         {', '.join(f'coalesce(t.{c}, 0) AS {c}' for c in _SUMMED)}
  FROM grid g LEFT JOIN tick_rows t ON t.market_id = g.market_id AND t.grp = g.tick
),
ticks AS ({_changes('grid_filled', 'tick')})"""
    )


_BLOCKS = _condensed("block_number", "block_rows") + f""",
blocks AS ({_changes('block_rows', 'block_number')})"""


def _attribution(source: str = "led", aggregated: bool = False) -> str:
    """Per-row attribution of any ledger with a row number ``rn`` per market."""
    if aggregated:
        flows = ", ".join(
            f"CAST({c} AS DOUBLE) AS {c}"
            for c in ("borrow_in_assets", "repay_out_assets", "liquidate_repay_assets",
                      "supply_in_assets", "withdraw_out_assets", "interest_assets")
        )
        base = f"SELECT * REPLACE ({flows.replace(' AS BIGINT', '')}) FROM {source}"
    else:
        of = lambda kind, col, sign: (
            f"CAST(CASE WHEN event_type = '{kind}' AND {sign} * {col} > 0 THEN {sign} * {col} ELSE 0 END AS DOUBLE)"
        )
        base = f"""SELECT *, {of('Borrow', 'delta_borrow_assets', 1)} AS borrow_in_assets,
          {of('Repay', 'delta_borrow_assets', -1)} AS repay_out_assets,
          {of('Liquidate', 'delta_borrow_assets', -1)} AS liquidate_repay_assets,
          {of('Supply', 'delta_supply_assets', 1)} AS supply_in_assets,
          {of('Withdraw', 'delta_supply_assets', -1)} AS withdraw_out_assets,
          CAST(CASE WHEN event_type = 'AccrueInterest' THEN delta_borrow_assets ELSE 0 END AS DOUBLE) AS interest_assets
          FROM {source}"""
    return f""",
fl AS ({base}),
lagged AS (
  SELECT *, borrow_rate_per_sec * 31536000::DOUBLE AS borrow_apr,
         greatest(1.0::DOUBLE, coalesce(CAST(lag(total_supplied_assets) OVER o AS DOUBLE), 0.0::DOUBLE)) AS d,
         coalesce(lag(utilization_rate) OVER o, 0.0::DOUBLE) AS up,
         coalesce(utilization_rate - lag(utilization_rate) OVER o, 0.0::DOUBLE) AS delta_u_real,
         coalesce(borrow_rate_per_sec * 31536000::DOUBLE - lag(borrow_rate_per_sec) OVER o * 31536000::DOUBLE, 0.0::DOUBLE) AS delta_borrow_apr
  FROM fl WINDOW o AS (PARTITION BY market_id ORDER BY rn)
),
parts AS (
  SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - utilization_rate) AS buffer,
         CAST(trunc(0.9::DOUBLE * total_supplied_assets - outstanding_borrow_assets) AS BIGINT) AS headroom_u90_assets,
         CAST(trunc(0.95::DOUBLE * total_supplied_assets - outstanding_borrow_assets) AS BIGINT) AS headroom_u95_assets,
         borrow_in_assets - repay_out_assets - liquidate_repay_assets AS net_borrow_principal_assets,
         supply_in_assets - withdraw_out_assets AS net_supply_assets,
         borrow_in_assets / d AS contrib_u_from_borrow,
         -repay_out_assets / d AS contrib_u_from_repay,
         -liquidate_repay_assets / d AS contrib_u_from_liquidate,
         up * (withdraw_out_assets / d) AS contrib_u_from_withdraw,
         -up * (supply_in_assets / d) AS contrib_u_from_supply,
         (interest_assets / d) * (1.0::DOUBLE - up) AS contrib_u_from_interest
  FROM lagged
),
summed AS (
  SELECT *, contrib_u_from_borrow + contrib_u_from_repay + contrib_u_from_liquidate + contrib_u_from_withdraw
            + contrib_u_from_supply + contrib_u_from_interest AS delta_u_pred
  FROM parts
),
attr AS (
  SELECT *, delta_u_real - delta_u_pred AS delta_u_residual,
         CASE WHEN abs(delta_u_real) > 1e-9 THEN delta_borrow_apr / delta_u_real END AS irm_slope,
         CASE WHEN abs(contrib_u_from_withdraw) > 1e-12 THEN delta_borrow_apr / contrib_u_from_withdraw END AS irm_response_to_withdraw,
         CASE WHEN abs(contrib_u_from_repay) > 1e-12 THEN delta_borrow_apr / contrib_u_from_repay END AS irm_response_to_repay,
         CASE WHEN abs(contrib_u_from_liquidate) > 1e-12 THEN delta_borrow_apr / contrib_u_from_liquidate END AS irm_response_to_liquidate,
         greatest(-1000.0::DOUBLE, least(1000.0::DOUBLE,
           CASE WHEN abs(delta_u_real) > 1e-9 THEN delta_borrow_apr / delta_u_real ELSE 0.0::DOUBLE END)) AS slope
  FROM summed
)"""


def _windowed(name: str, source: str, windows: dict[str, int | None], measures: dict[str, str]) -> str:
    """Self-join windows: ``measures`` maps an output stem to an aggregate over the joined rows ``j``;
    ``{w}`` stands for the width in seconds."""
    parts, joins, cols = [], [], ["b.*"]
    for k, (label, w) in enumerate(windows.items()):
        span = "" if w is None else f" AND j.block_timestamp > i.block_timestamp - {w}"
        aggs = ", ".join(f"{sql.replace('{w}', f'{float(w or 1)}::DOUBLE')} AS {stem}_{label}" for stem, sql in measures.items())
        parts.append(
            f"""{name}_{k} AS (SELECT i.market_id AS mk, i.rn AS rk, {aggs} FROM {source} i
  JOIN {source} j ON j.market_id = i.market_id AND j.rn <= i.rn{span} GROUP BY i.market_id, i.rn)"""
        )
        joins.append(f"JOIN {name}_{k} ON {name}_{k}.mk = b.market_id AND {name}_{k}.rk = b.rn")
        cols += [f"{name}_{k}.{stem}_{label}" for stem in measures]
    return ",\n" + ",\n".join(parts) + f",\n{name} AS (SELECT {', '.join(cols)} FROM {source} b {' '.join(joins)})"


_STD = "coalesce(stddev_samp(j.{c}), 0.0)"
LEVELS = {
    "util_mean": "avg(j.utilization_rate)",
    "util_max": "max(j.utilization_rate)",
    "util_std": _STD.replace("{c}", "utilization_rate"),
    "buffer_min": "min(j.buffer)",
    "borrow_apr_mean": "avg(j.borrow_apr)",
    "borrow_apr_max": "max(j.borrow_apr)",
    "borrow_apr_std": _STD.replace("{c}", "borrow_apr"),
}
_FLOW_OF = {"borrow": "borrow_in_assets", "repay": "repay_out_assets", "liquidate": "liquidate_repay_assets",
            "withdraw": "withdraw_out_assets", "supply": "supply_in_assets", "interest": "interest_assets"}
INTENSITIES = {f"{n}_intensity": f"sum(j.{c}) / {{w}}" for n, c in _FLOW_OF.items()} | {
    f"{n}_intensity_norm_supply": f"sum(j.{_FLOW_OF[n]}) / {{w}} / greatest(1.0::DOUBLE, avg(CAST(j.total_supplied_assets AS DOUBLE)))"
    for n in ("borrow", "withdraw", "repay")
}
_SHARED = ("withdraw", "repay", "liquidate", "borrow", "supply")
CONTRIBUTIONS = {f"contrib_{n}_sum": f"sum(j.contrib_u_from_{n})" for n in _SHARED} | {
    f"contrib_{n}_abs_sum": f"sum(abs(j.contrib_u_from_{n}))" for n in ("withdraw", "repay", "liquidate")
}
VOLATILITY = {
    "delta_u_std": _STD.replace("{c}", "delta_u_real"),
    "irm_slope_std": _STD.replace("{c}", "slope"),
}
SHARES = {
    f"vol_share_{n}": f"coalesce(covar_samp(j.contrib_u_from_{n}, j.delta_u_real), 0.0) "
    "/ greatest(1e-12::DOUBLE, coalesce(var_samp(j.delta_u_real), 0.0))"
    for n in _SHARED
}
ALL_TIME = {
    **{k: LEVELS[k] for k in ("util_mean", "util_std", "util_max", "borrow_apr_mean", "borrow_apr_std", "borrow_apr_max")},
    "delta_u_std": VOLATILITY["delta_u_std"],
}

_SPLIT = """,
split AS (
  SELECT *, borrow_rate_per_sec * 31536000::DOUBLE AS borrow_apr,
         CAST(CASE WHEN delta_borrow_assets > 0 THEN delta_borrow_assets ELSE 0 END AS DOUBLE) AS borrow_in_assets,
         CAST(CASE WHEN delta_borrow_assets < 0 THEN -delta_borrow_assets ELSE 0 END AS DOUBLE) AS borrow_out_assets,
         CAST(CASE WHEN delta_supply_assets > 0 THEN delta_supply_assets ELSE 0 END AS DOUBLE) AS supply_in_assets,
         CAST(CASE WHEN delta_supply_assets < 0 THEN -delta_supply_assets ELSE 0 END AS DOUBLE) AS supply_out_assets,
         CAST(CASE WHEN event_type = 'AccrueInterest' THEN delta_borrow_assets ELSE 0 END AS DOUBLE) AS interest_assets,
         CAST(utilization_rate > 0.90 AS TINYINT) AS regime_util_gt_90,
         CAST(utilization_rate > 0.95 AS TINYINT) AS regime_util_gt_95,
         CAST(utilization_rate > 0.99 AS TINYINT) AS regime_util_gt_99
  FROM led
),
steps AS (
  SELECT *, coalesce(borrow_apr - lag(borrow_apr) OVER o, 0.0) AS delta_borrow_apr
  FROM split WINDOW o AS (PARTITION BY market_id ORDER BY rn)
),
ela AS (
  SELECT *, CASE WHEN abs(delta_utilization) > 1e-9 THEN delta_borrow_apr / delta_utilization ELSE 0.0 END AS elasticity_apr_per_util
  FROM steps
)"""
INDICATORS = {
    "util_mean": LEVELS["util_mean"],
    "util_std": LEVELS["util_std"],
    "borrow_apr_mean": LEVELS["borrow_apr_mean"],
    "borrow_apr_std": LEVELS["borrow_apr_std"],
    "borrow_intensity": "sum(j.borrow_in_assets) / {w}",
    "repay_intensity": "sum(j.borrow_out_assets) / {w}",
    "supply_intensity": "sum(j.supply_in_assets) / {w}",
    "withdraw_intensity": "sum(j.supply_out_assets) / {w}",
    "interest_intensity": "CASE WHEN avg(CAST(j.outstanding_borrow_assets AS DOUBLE)) > 0 "
    "THEN sum(j.interest_assets) / avg(CAST(j.outstanding_borrow_assets AS DOUBLE)) ELSE 0.0 END",
}

EVENTS = "WITH" + _EVENTS
LEDGER = EVENTS + _STATE
TICKS = {fill: LEDGER + _ticks(fill) for fill in ("last", "running_max")}
BLOCKS = LEDGER + _BLOCKS
CORE = LEDGER + _attribution()
SPLIT = LEDGER + _SPLIT


def wide(sql: str) -> str:
    """The same query over amounts 10^15 times as large, in 128-bit integers."""
    larger = sql.replace("ELSE 200 END AS amount", "ELSE 200 END * 1000000000000000::HUGEINT AS amount")
    return larger.replace("AS BIGINT)", "AS HUGEINT)")


def attribution_windows(windows: dict[str, int | None], measures: dict[str, str]) -> str:
    return CORE + _windowed("win", "attr", windows, measures)


def indicator_windows(windows: dict[str, int]) -> str:
    return SPLIT + _windowed("win", "ela", windows, INDICATORS)


def tick_attribution(windows: dict[str, int | None], measures: dict[str, str]) -> str:
    numbered = ",\nnum AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY tick) AS rn FROM ticks)"
    return TICKS["last"] + numbered + _attribution("num", aggregated=True) + _windowed("win", "attr", windows, measures)


def downsampled_attribution(windows: dict[str, int | None], measures: dict[str, str], seconds: int = 300) -> str:
    kept = f""",
marked AS (
  SELECT *, row_number() OVER (PARTITION BY market_id, block_timestamp // {seconds} ORDER BY rn) AS f,
            row_number() OVER (PARTITION BY market_id, block_timestamp // {seconds} ORDER BY rn DESC) AS l
  FROM led
),
thin AS (
  SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY market_id ORDER BY rn) AS rn
  FROM marked WHERE f = 1 OR l = 1
)"""
    return LEDGER + kept + _attribution("thin") + _windowed("win", "attr", windows, measures)


def described(source: str, columns: list[str], probabilities: dict[str, float]) -> str:
    """Summary statistics of several columns of a CTE, one row per market and column."""
    quantiles = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in probabilities.items())
    one = [
        f"""SELECT market_id, '{c}' AS metric, count(*) AS count, avg(v) AS mean, stddev_samp(v) AS std,
 min(v) AS min, max(v) AS max, {quantiles} FROM (SELECT market_id, CAST({c} AS DOUBLE) AS v FROM {source})
 WHERE v IS NOT NULL GROUP BY market_id"""
        for c in columns
    ]
    return " UNION ALL ".join(one)
