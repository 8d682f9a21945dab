"""Registered queries: each a Spark plan over the lending events, with its DuckDB twin.

A query names its columns once: those compared as they are, and doubles, which both sides round and
pass through single precision (relative rounding), since sums may be added in another order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.functions import base_units
from poolscope.operators import attribution as A
from poolscope.operators import checks, contracts, indicators, reports, ticks
from poolscope.operators.rolling import Measures, rolling
from poolscope.operators.standardize import raw_ledger, raw_ledger_together
from poolscope.operators.state import with_running_state
from poolscope.plans import pipelines as P
from poolscope.schemas import AMOUNT_COLUMN, ATTRIBUTION_CORE, FLOW_TOTALS, LEDGER, RAW_LEDGER, WIDE, indicator_schema
from poolscope.session import settled
from poolscope.sources.events import EventStore, register
from verify import oracles as O


@dataclass(frozen=True)
class Query:
    plan: Callable[[EventStore], DataFrame]
    sql: str  # ends where the select list of the compared columns can be put in front
    source: str
    exact: list[str]
    doubles: list[str]

    def spark(self, store: EventStore) -> DataFrame:
        df = self.plan(store)
        # As DuckDB rounds: scaled, to a whole number, and back. Spark's round writes each double out as text and reads it again.
        rounded = [
            f"CAST(CAST(rint({c} * 1e{_digits(c)}D) / 1e{_digits(c)}D AS FLOAT) AS DOUBLE) + 0D AS {c}" for c in self.doubles
        ]
        return df.selectExpr(*[f"{c} AS {c}" for c in self.exact], *rounded)

    def oracle(self) -> str:
        rounded = [
            f"CAST(CAST(round({c}, {_digits(c)}) AS FLOAT) AS DOUBLE) + 0.0::DOUBLE AS {c}" for c in self.doubles
        ]
        return f"{self.sql}\nSELECT {', '.join([*self.exact, *rounded])} FROM {self.source}"


def _digits(column: str) -> int:
    """Decimals kept: fewer where a square root or a quotient of small numbers magnifies the last bits."""
    if "slope_std" in column or "vol_share" in column or "std" in column or column in ("mean", "cov_ub"):
        return 8
    if "rate_per_sec" in column:
        return 18
    return 12


_ROW = ["market_id", "block_number", "log_index"]
_QUERIES: dict[str, Query] = {}


def _add(name: str, plan, sql: str, source: str, exact: list[str], doubles: list[str] | None = None) -> None:
    _QUERIES[name] = Query(plan, sql, source, exact, doubles or [])


def _names(schema, kind: str) -> list[str]:
    return [f.name for f in schema.fields if (f.dataType.typeName() == "double") == (kind == "double")]


# Sources and standardization -------------------------------------------------------------------

_add("raw_event_counts", lambda s: reports.raw_event_counts(s.read_all()),
     O.EVENTS, "(SELECT market_id, event_type, count(*) AS rows FROM raw GROUP BY ALL)",
     ["market_id", "event_type", "rows"])

_add("market_scan",
     lambda s: s.read("Supply", market_ids="m0", columns=["id", "block_number", "log_index", "tx_hash"],
                      extra_where="block_timestamp >= ? AND log_index > ?", extra_args=[1704500000, 100]),
     O.EVENTS,
     "(SELECT market_id AS id, block_number, log_index, tx_hash FROM raw WHERE event_type = 'Supply'"
     " AND market_id = 'm0' AND block_timestamp >= 1704500000 AND log_index > 100)",
     ["id", "block_number", "log_index", "tx_hash"])

_add("parse_amounts",
     lambda s: raw_ledger_together(s.read_together()).selectExpr(
         *_ROW, "event_type",
         "greatest(abs(delta_supply_assets), abs(delta_borrow_assets), abs(delta_collateral_assets)) AS amount"),
     O.EVENTS, "amounts", [*_ROW, "event_type", "amount"])

_add("raw_ledger", lambda s: raw_ledger(s.read_all()),
     O.EVENTS, "raw", _names(RAW_LEDGER, "exact"), _names(RAW_LEDGER, "double"))

# State -----------------------------------------------------------------------------------------

_add("enriched_ledger", P.enriched_ledger_dataset, O.LEDGER, "led",
     _names(LEDGER, "exact"), _names(LEDGER, "double"))

_add("enriched_ledger_zero_rate",
     lambda s: P.enriched_ledger_dataset(s, leading_rate="zero"), O.LEDGER,
     "(SELECT market_id, block_number, log_index, coalesce(borrow_rate_per_sec, 0) AS borrow_rate_per_sec,"
     " coalesce(borrow_apy, 0) AS borrow_apy, coalesce(supply_apy, 0) AS supply_apy FROM led)",
     _ROW, ["borrow_rate_per_sec", "borrow_apy", "supply_apy"])

_add("rate_ffill",
     lambda s: with_running_state(raw_ledger_together(s.read_together())).withColumnRenamed("_row", "position"),
     O.LEDGER, "(SELECT *, rn AS position FROM run)", [*_ROW, "position"], ["borrow_rate_per_sec"])

_add("running_totals", lambda s: with_running_state(raw_ledger_together(s.read_together())),
     O.LEDGER, "run", [*_ROW, "total_supplied_assets", "outstanding_borrow_assets", "total_collateral_assets"])

class _Wide(EventStore):
    """The same events, with amounts 10^15 times as large."""

    def read_together(self, market_ids=None) -> DataFrame:
        df = super().read_together(market_ids)
        larger = lambda c: (base_units(F.col(c), name=c, amount_type=WIDE) * 10**15).cast(WIDE).cast("string")
        return df.withColumns({c: larger(c) for c in dict.fromkeys(AMOUNT_COLUMN.values())})


def _wide(plan: Callable[..., DataFrame], text: list[str], **options) -> Callable[[EventStore], DataFrame]:
    """A pipeline over wide amounts, with some columns as text: the two engines hand over wide numbers in different types."""
    def over(store: EventStore) -> DataFrame:
        df = plan(_Wide(store.spark, store.root, store.layout), amount_type=WIDE, **options)
        return df.withColumns({f"{c}_text": F.col(c).cast("string") for c in text})
    return over


def _as_text(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}_text" for c in columns)


_WIDE_TOTALS = ["delta_supply_assets", "total_supplied_assets", "outstanding_borrow_assets", "total_collateral_assets"]
_WIDE_FLOWS = [*_WIDE_TOTALS, "supply_in_assets", "repay_out_assets", "collateral_out_assets"]
_add("enriched_ledger_wide", _wide(P.enriched_ledger_dataset, _WIDE_TOTALS), O.wide(O.LEDGER),
     f"(SELECT *, {_as_text(_WIDE_TOTALS)} FROM led)", [*_ROW, *[f"{c}_text" for c in _WIDE_TOTALS]],
     ["utilization_rate", "supply_apy", "delta_utilization"])
_add("tick_ledger_wide", _wide(P.tick_dataset, _WIDE_FLOWS), O.wide(O.TICKS["last"]),
     f"(SELECT *, {_as_text(_WIDE_FLOWS)} FROM ticks)",
     ["market_id", "block_number", "block_timestamp", "event_count", *[f"{c}_text" for c in _WIDE_FLOWS]], ["utilization_rate"])
_add("headroom_wide",
     _wide(lambda s, **o: A.attribution_core(P.ledger_state(s, **o)).withColumns(
         {c: F.col(c).cast("double") for c in ("headroom_u90_assets", "headroom_u95_assets")}), ["outstanding_borrow_assets"]),
     O.wide(O.CORE),
     f"(SELECT * REPLACE (CAST(headroom_u90_assets AS DOUBLE) AS headroom_u90_assets, CAST(headroom_u95_assets AS DOUBLE)"
     f" AS headroom_u95_assets), {_as_text(['outstanding_borrow_assets'])} FROM attr)",
     [*_ROW, "outstanding_borrow_assets_text"], ["headroom_u90_assets", "headroom_u95_assets", "delta_u_real"])

_add("latest_state", lambda s: reports.latest_state(P.enriched_ledger_dataset(s)), O.LEDGER,
     "(SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY rn DESC) = 1)",
     ["market_id", "block_number", "total_supplied_assets", "outstanding_borrow_assets", "total_collateral_assets"],
     ["utilization_rate", "borrow_apy", "supply_apy"])

_add("time_series",
     lambda s: reports.time_series(P.enriched_ledger_dataset(s), 100).withColumn(
         "timestamp_ms", F.unix_millis("timestamp")),
     O.LEDGER,
     "(SELECT *, epoch_ms(epoch_ms(block_timestamp * 1000)) AS timestamp_ms FROM led"
     " ORDER BY block_number, log_index, market_id LIMIT 100)",
     [*_ROW, "timestamp_ms", "total_supplied_assets", "outstanding_borrow_assets"],
     ["utilization_rate", "borrow_apy", "supply_apy"])

_add("event_counts", lambda s: reports.event_counts(P.enriched_ledger_dataset(s)), O.EVENTS,
     "(SELECT market_id, event_type, count(*) AS event_count FROM raw GROUP BY ALL)",
     ["market_id", "event_type", "event_count"])

_add("event_type_summary", lambda s: reports.event_type_summary(P.enriched_ledger_dataset(s)), O.LEDGER,
     "(SELECT market_id, event_type, count(*) AS event_count, avg(utilization_rate) AS avg_utilization,"
     " avg(borrow_apy) AS avg_borrow_apy, avg(supply_apy) AS avg_supply_apy FROM led GROUP BY ALL"
     " ORDER BY event_count DESC)",
     ["market_id", "event_type", "event_count"], ["avg_utilization", "avg_borrow_apy", "avg_supply_apy"])


def _sql_on_view(store: EventStore) -> DataFrame:
    register(P.enriched_ledger_dataset(store), "enriched_ledger_view")
    return store.spark.sql(
        "SELECT market_id, block_timestamp div 3600 AS hour, count(*) AS events, max(utilization_rate) AS top"
        " FROM enriched_ledger_view WHERE event_type IN ('Borrow', 'Repay') GROUP BY ALL"
    )


_add("sql_on_view", _sql_on_view, O.LEDGER,
     "(SELECT market_id, block_timestamp // 3600 AS hour, count(*) AS events, max(utilization_rate) AS top"
     " FROM led WHERE event_type IN ('Borrow', 'Repay') GROUP BY ALL)",
     ["market_id", "hour", "events"], ["top"])

# Ticks and blocks ------------------------------------------------------------------------------

_TICK_EXACT = [*_names(LEDGER, "exact"), *FLOW_TOTALS, "event_count"]
_TICK_DOUBLES = _names(LEDGER, "double")
for _fill in ("last", "running_max"):
    _add(f"tick_ledger_{_fill}", lambda s, fill=_fill: P.tick_dataset(s, fill=fill), O.TICKS[_fill], "ticks",
         _TICK_EXACT, _TICK_DOUBLES)
_add("block_ledger", lambda s: P.tick_dataset(s, aggregation_level="block"), O.BLOCKS, "blocks",
     _TICK_EXACT, _TICK_DOUBLES)
_add("first_last_per_tick", lambda s: ticks.first_last_per_tick(P.enriched_ledger_dataset(s), tick_seconds=3600),
     O.LEDGER,
     "(SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY market_id, block_timestamp // 3600 ORDER BY rn) = 1"
     " OR row_number() OVER (PARTITION BY market_id, block_timestamp // 3600 ORDER BY rn DESC) = 1)",
     [*_ROW, "event_type", "total_supplied_assets"], ["utilization_rate"])
_add("tick_accounting", lambda s: reports.tick_accounting(P.tick_dataset(s)), O.TICKS["last"],
     "(SELECT *, borrow_in_assets - repay_out_assets - liquidate_repay_assets + interest_assets AS borrow_flows,"
     " supply_in_assets - withdraw_out_assets + interest_assets AS supply_flows,"
     " abs(borrow_in_assets - repay_out_assets - liquidate_repay_assets + interest_assets - delta_borrow_assets) < 1 AS borrow_match,"
     " abs(supply_in_assets - withdraw_out_assets + interest_assets - delta_supply_assets) < 1 AS supply_match"
     " FROM ticks WHERE event_count > 1)",
     ["market_id", "block_number", "block_timestamp", "event_count", "borrow_flows", "supply_flows",
      "delta_borrow_assets", "delta_supply_assets", "borrow_match", "supply_match"])

# Rolling windows -------------------------------------------------------------------------------

_WIDTHS = {"5min": 300, "6h": 21_600, "7d": 604_800}


def _roll(measures: Measures, outputs, widths: dict[str, int | None] | None = None):
    def plan(store: EventStore) -> DataFrame:
        df = P.ledger_state(store).withColumn(
            "supplied", F.greatest("delta_supply_assets", F.lit(0)).cast("double"))
        return rolling(df, measures, widths or _WIDTHS, outputs, repeats=False)
    return plan


def _rolled(stems: list[str], widths=_WIDTHS) -> list[str]:
    return [f"{stem}_{label}" for label in widths for stem in stems]


_WITH_SUPPLIED = O.LEDGER + (
    ",\nsup AS (SELECT *, CAST(CASE WHEN delta_supply_assets > 0 THEN delta_supply_assets ELSE 0 END AS DOUBLE)"
    " AS supplied FROM led)")

_add("rolling_mean_std",
     _roll(Measures(levels=("utilization_rate", "borrow_apy"), nullable=frozenset({"borrow_apy"})),
           lambda w: [(f"mean_u_{w.label}", w.mean("utilization_rate")), (f"std_u_{w.label}", w.std("utilization_rate")),
                      (f"mean_apy_{w.label}", w.mean("borrow_apy")), (f"std_apy_{w.label}", w.std("borrow_apy"))]),
     _WITH_SUPPLIED + O._windowed("win", "sup", _WIDTHS, {
         "mean_u": "avg(j.utilization_rate)", "std_u": "coalesce(stddev_samp(j.utilization_rate), 0)",
         "mean_apy": "avg(j.borrow_apy)", "std_apy": "coalesce(stddev_samp(j.borrow_apy), 0)"}),
     "win", _ROW, _rolled(["mean_u", "std_u", "mean_apy", "std_apy"]))
_add("rolling_min_max",
     _roll(Measures(highs=("utilization_rate", "borrow_apy"), lows=("utilization_rate", "borrow_apy")),
           lambda w: [(f"max_u_{w.label}", w.max("utilization_rate")), (f"min_u_{w.label}", w.min("utilization_rate")),
                      (f"max_apy_{w.label}", w.max("borrow_apy")), (f"min_apy_{w.label}", w.min("borrow_apy"))]),
     _WITH_SUPPLIED + O._windowed("win", "sup", _WIDTHS, {
         "max_u": "max(j.utilization_rate)", "min_u": "min(j.utilization_rate)",
         "max_apy": "max(j.borrow_apy)", "min_apy": "min(j.borrow_apy)"}),
     "win", _ROW, _rolled(["max_u", "min_u", "max_apy", "min_apy"]))
_add("rolling_sum",
     _roll(Measures(sums=("supplied", "borrow_apy"), nullable=frozenset({"borrow_apy"})),
           lambda w: [(f"sum_{w.label}", w.sum("supplied")), (f"apy_sum_{w.label}", w.sum("borrow_apy"))]),
     _WITH_SUPPLIED + O._windowed("win", "sup", _WIDTHS, {"sum": "sum(j.supplied)", "apy_sum": "sum(j.borrow_apy)"}),
     "win", _ROW, _rolled(["sum", "apy_sum"]))
_add("rolling_cov",
     _roll(Measures(changes=("delta_utilization",), pairs=(("delta_utilization", "utilization_rate"),)),
           lambda w: [(f"cov_{w.label}", w.cov("delta_utilization", "utilization_rate")),
                      (f"du_std_{w.label}", w.std("delta_utilization"))]),
     _WITH_SUPPLIED + O._windowed("win", "sup", _WIDTHS, {
         "cov": "coalesce(covar_samp(j.delta_utilization, j.utilization_rate), 0)",
         "du_std": "coalesce(stddev_samp(j.delta_utilization), 0)"}),
     "win", _ROW, _rolled(["cov", "du_std"]))
_EXPANDING = {"expanding": None}
_add("expanding", lambda s: A.attribution(P.ledger_state(s), compute_windows=[]),
     O.attribution_windows(_EXPANDING, O.ALL_TIME), "win", _ROW, _rolled(list(O.ALL_TIME), _EXPANDING))

# Indicators ------------------------------------------------------------------------------------

_add("flow_split", lambda s: indicators.flow_split(P.enriched_ledger_dataset(s)), O.SPLIT, "split", _ROW,
     ["borrow_in_assets", "borrow_out_assets", "supply_in_assets", "supply_out_assets", "interest_assets"])
_add("elasticity", lambda s: indicators.elasticity(P.enriched_ledger_dataset(s)), O.SPLIT, "ela", _ROW,
     ["borrow_apr", "delta_borrow_apr", "delta_utilization", "elasticity_apr_per_util"])
_add("regime_flags", lambda s: indicators.regime_flags(P.enriched_ledger_dataset(s)), O.SPLIT, "split",
     [*_ROW, "regime_util_gt_90", "regime_util_gt_95", "regime_util_gt_99"])
_add("market_indicators", P.indicator_dataset,
     O.indicator_windows({"5min": 300, "1h": 3_600, "6h": 21_600}),
     "(SELECT *, borrow_apr_mean_6h AS borrow_apr_6h_avg_ui FROM win)",
     _names(indicator_schema(), "exact"), _names(indicator_schema(), "double"))

# Attribution per row ---------------------------------------------------------------------------

_FLOW_COLUMNS = ["borrow_in_assets", "repay_out_assets", "liquidate_repay_assets", "supply_in_assets",
                 "withdraw_out_assets", "interest_assets", "net_borrow_principal_assets", "net_supply_assets"]
_PARTS = [f"contrib_u_from_{n}" for n in ("borrow", "repay", "liquidate", "withdraw", "supply", "interest")]
_SLOPES = ["irm_slope", *[f"irm_response_to_{n}" for n in ("withdraw", "repay", "liquidate")]]


def _core(store: EventStore) -> DataFrame:
    return A.attribution_core(P.ledger_state(store))


_add("headroom", _core, O.CORE, "attr", [*_ROW, "headroom_u90_assets", "headroom_u95_assets"], ["borrow_apr", "buffer"])
_add("flows", _core, O.CORE, "attr", _ROW, _FLOW_COLUMNS)
_add("contributions", _core, O.CORE, "attr", _ROW, [*_PARTS, "delta_u_pred", "delta_u_real", "delta_u_residual"])
_add("irm_slope", _core, O.CORE, "attr", _ROW, ["delta_borrow_apr", *_SLOPES])
_add("attribution_core_of_ledger", lambda s: A.attribution_core(P.enriched_ledger_dataset(s)), O.CORE, "attr",
     _names(ATTRIBUTION_CORE, "exact"), _names(ATTRIBUTION_CORE, "double"))

# Attribution windows ---------------------------------------------------------------------------

_SHORT = {"5min": 300, "1h": 3_600, "24h": 86_400}
_LONG = {"7d": 604_800, "30d": 2_592_000, "365d": 31_536_000}
for _name, _measures in {
    "attr_levels": O.LEVELS, "attr_intensity": O.INTENSITIES, "attr_contrib_sums": O.CONTRIBUTIONS,
    "attr_volatility": O.VOLATILITY, "vol_share": O.SHARES,
}.items():
    _add(_name, lambda s: A.attribution(P.ledger_state(s), compute_windows=_SHORT, expanding=False),
         O.attribution_windows(_SHORT, _measures), "win", _ROW, _rolled(list(_measures), _SHORT))
_LONG_MEASURES = O.LEVELS | O.INTENSITIES | O.CONTRIBUTIONS | O.VOLATILITY
_add("attr_long_windows", lambda s: A.attribution(P.ledger_state(s), compute_windows=_LONG, expanding=False),
     O.attribution_windows(_LONG, _LONG_MEASURES), "win", _ROW, _rolled(list(_LONG_MEASURES), _LONG))
_SHARE_WINDOWS = {**_LONG, "90d": 7_776_000}
_add("vol_share_long", lambda s: A.attribution(P.ledger_state(s), compute_windows=_SHARE_WINDOWS, expanding=False),
     O.attribution_windows(_SHARE_WINDOWS, O.SHARES), "win", _ROW, _rolled(list(O.SHARES), _SHARE_WINDOWS))
_add("attribution_dataset", lambda s: P.attribution_dataset(s, compute_windows=_SHORT)[0],
     O.attribution_windows(_SHORT, O.LEVELS), "win", _names(ATTRIBUTION_CORE, "exact"),
     [*_names(ATTRIBUTION_CORE, "double"), *_rolled(list(O.LEVELS), _SHORT)])
_SOME = {k: (O.LEVELS | O.INTENSITIES | O.CONTRIBUTIONS | O.VOLATILITY)[k]
         for k in ("util_mean", "util_max", "util_std", "borrow_apr_mean", "borrow_intensity", "supply_intensity",
                   "interest_intensity", "contrib_borrow_sum", "contrib_withdraw_abs_sum", "delta_u_std")}
_DAY = {"1h": 3_600, "24h": 86_400}
_add("attribution_of_ticks",
     lambda s: A.attribution(settled(P.tick_dataset(s)), compute_windows=_DAY, expanding=False),
     O.tick_attribution(_DAY, _SOME), "win",
     [*_ROW, "block_timestamp", "event_count"], [*_FLOW_COLUMNS[:6], *_PARTS, *_rolled(list(_SOME), _DAY)])
_add("attribution_first_last",
     lambda s: A.attribution(P.enriched_ledger_dataset(s), compute_windows=_DAY, expanding=False, first_last_only=True),
     O.downsampled_attribution(_DAY, _SOME), "win", _ROW, [*_PARTS, "delta_u_residual", *_rolled(list(_SOME), _DAY)])

# Checks and reports ----------------------------------------------------------------------------

_INT_NULLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in checks.INTEGER_COLUMNS)
_IDENTITY = "abs(borrow_in_assets - repay_out_assets - liquidate_repay_assets + interest_assets - CAST(delta_borrow_assets AS DOUBLE))"
_SUPPLY_OFF = "abs(CAST(delta_supply_assets AS DOUBLE) - interest_assets)"
_BORROW_OFF = "abs(CAST(delta_borrow_assets AS DOUBLE) - interest_assets)"


def _check(name: str, severity: str, violations: str, largest: str, limit: str = "violations = 0") -> str:
    return (f"SELECT market_id, '{name}' AS \"check\", '{severity}' AS severity, violations, max_value, {limit} AS passed FROM"
            f" (SELECT market_id, count(*) AS total, CAST(sum({violations}) AS BIGINT) AS violations,"
            f" CAST({largest} AS DOUBLE) AS max_value FROM attr GROUP BY market_id)")


def _disorder(time: str) -> str:
    """Rows before their predecessor in time, and blocks with several times, per market."""
    return (f"(SELECT market_id, count(*) AS rows, count(*) FILTER (WHERE ts < before) AS backward_rows,"
            f" count(DISTINCT block_number) FILTER (WHERE lo < hi) AS split_blocks FROM"
            f" (SELECT *, lag(ts) OVER (PARTITION BY market_id ORDER BY rn) AS before,"
            f" min(ts) OVER (PARTITION BY market_id, block_number) AS lo, max(ts) OVER (PARTITION BY market_id, block_number) AS hi"
            f" FROM (SELECT *, {time} AS ts FROM led)) GROUP BY market_id)")


_REPORT = O.CORE + ",\nreport AS (" + " UNION ALL ".join([
    _check("integer_nulls", "error", _INT_NULLS, f"sum({_INT_NULLS})"),
    _check("utilization_bounds", "error", "CAST(utilization_rate < 0 OR utilization_rate > 1 AS INT)", "max(utilization_rate)"),
    _check("flow_identity", "error", f"CAST({_IDENTITY} > 1 AS INT)", f"max({_IDENTITY})"),
    _check("residual_size", "warning", "CAST(abs(delta_u_residual) > 0.01 AS INT)", "max(abs(delta_u_residual))",
           "violations <= total * 0.05"),
    _check("interest_equals_supply_delta", "warning",
           f"CAST(event_type = 'AccrueInterest' AND {_SUPPLY_OFF} > 1 + 1e-5 * abs(interest_assets) AS INT)",
           f"max({_SUPPLY_OFF}) FILTER (WHERE event_type = 'AccrueInterest')"),
    _check("interest_equals_borrow_delta", "warning",
           f"CAST(event_type = 'AccrueInterest' AND {_BORROW_OFF} > 1 + 1e-5 * abs(interest_assets) AS INT)",
           f"max({_BORROW_OFF}) FILTER (WHERE event_type = 'AccrueInterest')"),
    f"SELECT market_id, 'timestamp_order', 'error', backward_rows + split_blocks, CAST(backward_rows + split_blocks AS DOUBLE),"
    f" backward_rows + split_blocks = 0 FROM {_disorder('block_timestamp')}",
]) + ")"
_add("integrity_report", lambda s: checks.integrity_report(_core(s)).withColumnRenamed("check", "check_name"), _REPORT,
     '(SELECT *, "check" AS check_name FROM report)',
     ["market_id", "check_name", "severity", "violations", "passed"], ["max_value"])
_add("integrity_verdict",
     lambda s: checks.passed(checks.integrity_report(_core(s))).select(
         "market_id", "passed", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings")),
     _REPORT,
     "(SELECT market_id, bool_and(passed OR severity <> 'error') AS passed,"
     " coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (WHERE NOT passed AND severity = 'error'), '') AS errors,"
     " coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (WHERE NOT passed AND severity = 'warning'), '') AS warnings"
     " FROM report GROUP BY market_id)",
     ["market_id", "passed", "errors", "warnings"])
# The same rule on both sides puts some rows back in time, which also splits their blocks.
_LATE = "block_timestamp - CASE WHEN log_index % 97 = 0 THEN 1000 ELSE 0 END"
for _name, _time in (("timestamp_order", "block_timestamp"), ("timestamp_disorder", _LATE)):
    _add(_name, lambda s, time=_time: checks.timestamp_order(
        raw_ledger_together(s.read_together()).withColumn("block_timestamp", F.expr(time))),
        O.LEDGER, _disorder(_time), ["market_id", "rows", "backward_rows", "split_blocks"])

_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def _share(source: str, condition: str, name: str) -> str:
    return (f"(SELECT d.*, l.{name}, l.{name}_share FROM stats d JOIN (SELECT market_id,"
            f" count(*) FILTER (WHERE {condition}) AS {name}, count(*) FILTER (WHERE {condition}) / count(*) AS {name}_share"
            f" FROM {source} GROUP BY market_id) l ON l.market_id = d.market_id)")


_add("residual_summary", lambda s: reports.residual_summary(_core(s)),
     O.CORE + f",\nstats AS ({O.described('attr', ['delta_u_residual'], _QUARTILES)})",
     _share("attr", "abs(delta_u_residual) > 0.01", "large_residuals"),
     ["market_id", "count", "large_residuals"], [*_STATS, "large_residuals_share"])
_add("irm_summary", lambda s: reports.irm_summary(_core(s)),
     O.CORE + ",\nsloped AS (SELECT * FROM attr WHERE irm_slope IS NOT NULL)"
     + f",\nstats AS ({O.described('sloped', ['irm_slope'], _QUARTILES)})",
     _share("sloped", "abs(irm_slope) > 1", "steep_slopes"),
     ["market_id", "count", "steep_slopes"], [*_STATS, "steep_slopes_share"])
_SUMMARY = {k: v for k, v in (O.INTENSITIES | O.CONTRIBUTIONS | O.SHARES).items()}
_HOUR = {"6h": 21_600}
_add("window_summary",
     lambda s: reports.window_summary(
         A.attribution(P.ledger_state(s), compute_windows=_HOUR, expanding=False), "6h"),
     O.attribution_windows(_HOUR, _SUMMARY), f"({O.described('win', _rolled(list(_SUMMARY), _HOUR), _QUARTILES)})",
     ["market_id", "metric", "count"], _STATS)
_add("quality_summary", lambda s: reports.quality_summary(_core(s)), O.CORE,
     "(SELECT market_id, count(*) FILTER (WHERE delta_supply_assets IS NULL) AS nulls_delta_supply_assets,"
     " count(*) FILTER (WHERE delta_borrow_assets IS NULL) AS nulls_delta_borrow_assets,"
     " count(*) FILTER (WHERE total_supplied_assets IS NULL) AS nulls_total_supplied_assets,"
     " count(*) FILTER (WHERE outstanding_borrow_assets IS NULL) AS nulls_outstanding_borrow_assets,"
     " min(utilization_rate) AS min_utilization, max(utilization_rate) AS max_utilization,"
     " count(*) FILTER (WHERE utilization_rate < 0 OR utilization_rate > 1) AS out_of_bounds,"
     " count(*) FILTER (WHERE abs(delta_u_residual) > 0.01) AS large_residuals,"
     f" max({_IDENTITY}) AS max_flow_diff, avg({_IDENTITY}) AS mean_flow_diff,"
     f" count(*) FILTER (WHERE {_IDENTITY} > 1) AS flow_diffs,"
     " avg(abs(delta_u_residual)) AS mean_residual, quantile_cont(abs(delta_u_residual), 0.5) AS median_residual,"
     " quantile_cont(abs(delta_u_residual), 0.95) AS p95_residual, max(abs(delta_u_residual)) AS max_residual"
     " FROM attr GROUP BY market_id)",
     ["market_id", "nulls_delta_supply_assets", "nulls_delta_borrow_assets", "nulls_total_supplied_assets",
      "nulls_outstanding_borrow_assets", "out_of_bounds", "large_residuals", "flow_diffs"],
     ["min_utilization", "max_utilization", "max_flow_diff", "mean_flow_diff", "mean_residual", "median_residual",
      "p95_residual", "max_residual"])
_TOTALS = [f"total_{f}" for f in _FLOW_COLUMNS[:6]]
_add("flow_totals", lambda s: reports.flow_totals(_core(s)), O.CORE,
     f"(SELECT market_id, {', '.join(f'sum({t[6:]}) AS {t}' for t in _TOTALS)} FROM attr GROUP BY market_id)",
     ["market_id"], _TOTALS)
_add("significant_moves", lambda s: reports.significant_moves(_core(s)), O.CORE,
     "(SELECT * FROM attr WHERE abs(delta_u_real) > 0.001)", [*_ROW, "event_type"],
     ["delta_u_real", "delta_u_pred", *_PARTS, "delta_u_residual"])
_add("nonzero_flows", lambda s: reports.nonzero_flows(_core(s)), O.CORE,
     f"(SELECT * FROM attr WHERE {' OR '.join(f'{c} <> 0' for c in _FLOW_COLUMNS[:6])})",
     [*_ROW, "event_type"], _FLOW_COLUMNS[:6])
_add("steep_slopes", lambda s: reports.steep_slopes(_core(s)), O.CORE,
     "(SELECT * FROM attr WHERE abs(irm_slope) > 1)", [*_ROW, "event_type"], ["delta_u_real", "delta_borrow_apr", *_SLOPES])
_add("value_ranges", lambda s: reports.value_ranges(_core(s)), O.CORE,
     "(SELECT market_id, min(utilization_rate) AS min_utilization_rate, max(utilization_rate) AS max_utilization_rate,"
     " min(borrow_apr) AS min_borrow_apr, max(borrow_apr) AS max_borrow_apr FROM attr GROUP BY market_id)",
     ["market_id"], ["min_utilization_rate", "max_utilization_rate", "min_borrow_apr", "max_borrow_apr"])
_LATEST = _rolled(["util_mean", "util_max", "util_std"], _HOUR)
_add("latest_rows",
     lambda s: reports.latest_rows(
         A.attribution(P.ledger_state(s), compute_windows=_HOUR, expanding=False), _LATEST, 20),
     O.attribution_windows(_HOUR, O.LEVELS),
     "(SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY rn DESC) AS age FROM win QUALIFY age <= 20)",
     [*_ROW, "age"], _LATEST)
_add("latest_all_time",
     lambda s: reports.latest_rows(A.attribution(P.ledger_state(s), compute_windows=[]), _rolled(list(O.ALL_TIME), _EXPANDING), 1),
     O.attribution_windows(_EXPANDING, O.ALL_TIME),
     "(SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY rn DESC) AS age FROM win QUALIFY age <= 1)",
     [*_ROW, "age"], _rolled(list(O.ALL_TIME), _EXPANDING))


_add("ordered_output", lambda s: reports.output_positions(P.enriched_ledger_dataset(s)), O.LEDGER,
     "(SELECT *, row_number() OVER (ORDER BY block_number, log_index, market_id) AS position FROM led)",
     [*_ROW, "position", "event_type", "total_supplied_assets"], ["utilization_rate"])

_ALL = {**_SHORT, "6h": 21_600, **_SHARE_WINDOWS}
_EVERY = O.LEVELS | O.INTENSITIES | O.CONTRIBUTIONS | O.VOLATILITY | O.SHARES
_add("attribution_dataset_full", lambda s: P.attribution_dataset(s)[0],
     O.attribution_windows(_ALL, _EVERY) + O._windowed("whole", "win", _EXPANDING, O.ALL_TIME), "whole",
     _names(ATTRIBUTION_CORE, "exact"),
     [*_names(ATTRIBUTION_CORE, "double"), *_rolled(list(_EVERY), _ALL), *_rolled(list(O.ALL_TIME), _EXPANDING)])

# Contracts: the same table as it is, and with some rows and columns spoilt on both sides.

_SPOILT = {"market_id": "log_index % 101 = 0", "total_supplied_assets": "log_index % 97 = 0"}
_BEYOND = "log_index % 89 = 0"


def _spoil(df: DataFrame, drop: str | None) -> DataFrame:
    out = df.withColumns({c: F.expr(f"CASE WHEN NOT ({rule}) THEN {c} END") for c, rule in _SPOILT.items() if c in df.columns})
    if "utilization_rate" in df.columns:
        out = out.withColumn("utilization_rate", F.expr(f"utilization_rate + CASE WHEN {_BEYOND} THEN 2 ELSE 0 END"))
    return (out.drop(drop) if drop else out).withColumn("note", F.lit("extra"))


def _contracted(table: Callable[[EventStore], DataFrame], rules: Callable[[DataFrame], list], drop: str):
    def report(store: EventStore) -> DataFrame:
        good, spoilt = table(store), _spoil(table(store), drop)
        lines = [contracts.contract_report(df, rules(df)).withColumn("side", F.lit(side)) for side, df in (("good", good), ("spoilt", spoilt))]
        return lines[0].unionByName(lines[1])
    return report


def _contract_sql(source: str, schema, drop: str, nullable: tuple[str, ...], *, extra: int, bounds: bool) -> str:
    """The same lines from plain counts over ``source``."""
    filled = [f.name for f in schema.fields if not f.nullable and f.name not in nullable]
    lines = []
    for side in ("good", "spoilt"):
        gone = side == "spoilt"
        counts = {"no_rows": "CAST(count(*) = 0 AS BIGINT)", "missing_columns": f"{int(gone)}", "extra_columns": f"{extra * gone}",
                  "misplaced_columns": "0", "not_whole_columns": "0"}
        for c in filled:
            if not (gone and c == drop):
                broken = _SPOILT.get(c) if gone else None
                counts[f"null_{c}"] = f"count(*) FILTER (WHERE {c} IS NULL{f' OR {broken}' if broken else ''})"
        if bounds:
            shifted = f"utilization_rate + CASE WHEN {_BEYOND} THEN 2 ELSE 0 END" if gone else "utilization_rate"
            counts["bounds_utilization_rate"] = f"count(*) FILTER (WHERE NOT coalesce({shifted} BETWEEN -1e-12 AND 1 + 1e-12, FALSE))"
        lines += [f"SELECT '{side}' AS side, '{rule}' AS rule, count(*) AS rows, CAST({n} AS BIGINT) AS violations FROM {source}" for rule, n in counts.items()]
    return f"(SELECT *, violations = 0 AS passed FROM ({' UNION ALL '.join(lines)}))"


_LINES = ["side", "rule", "rows", "violations", "passed"]
_add("contract_raw_ledger", _contracted(lambda s: raw_ledger(s.read_all()), contracts.raw_ledger_contract, "tx_hash"), O.EVENTS,
     _contract_sql("raw", RAW_LEDGER, "tx_hash", (), extra=1, bounds=False), _LINES)
_add("contract_ledger", _contracted(P.enriched_ledger_dataset, contracts.ledger_contract, "tx_hash"), O.LEDGER,
     _contract_sql("led", LEDGER, "tx_hash", contracts._RATES, extra=0, bounds=True), _LINES)
_add("contract_attribution", _contracted(_core, contracts.attribution_contract, "buffer"), O.CORE,
     _contract_sql("attr", ATTRIBUTION_CORE, "buffer", (*contracts._RATES, "borrow_apr", "delta_borrow_apr"), extra=0, bounds=True), _LINES)
_FLAGS = tuple(c for c in indicator_schema().names if c.startswith(("borrow_apr", "delta_borrow_apr", "elasticity")))
_add("contract_indicators", _contracted(P.indicator_dataset, contracts.indicator_contract, "tx_hash"),
     O.indicator_windows({"5min": 300, "1h": 3_600, "6h": 21_600}),
     _contract_sql("win", indicator_schema(), "tx_hash", (*contracts._RATES, *_FLAGS), extra=1, bounds=True), _LINES)


def _event_contracts(store: EventStore) -> DataFrame:
    """Each raw table, and each without its transaction hashes and with some markets unset."""
    lines = []
    for event, df in store.read_all().items():
        for side, table in (("good", df), ("spoilt", df.drop("tx_hash").withColumn("id", F.expr("CASE WHEN log_index % 101 > 0 THEN id END")))):
            report = contracts.contract_report(table, contracts.event_contract(table, event))
            lines.append(report.withColumns({"side": F.lit(side), "event_type": F.lit(event)}))
    return reduce(DataFrame.unionByName, lines).where("rule IN ('no_rows', 'missing_columns', 'null_id', 'null_block_number')")


_add("contract_raw_events", _event_contracts, O.EVENTS,
     "(SELECT event_type, side, rule, rows, violations, violations = 0 AS passed FROM (SELECT event_type, side, rule, count(*) AS rows,"
     " CAST(CASE WHEN side = 'good' THEN 0 WHEN rule = 'missing_columns' THEN 1 WHEN rule = 'null_id' THEN count(*) FILTER (WHERE log_index % 101 = 0)"
     " ELSE 0 END AS BIGINT) AS violations FROM raw, (VALUES ('good'), ('spoilt')) s(side),"
     " (VALUES ('no_rows'), ('missing_columns'), ('null_id'), ('null_block_number')) r(rule) GROUP BY event_type, side, rule))",
     ["event_type", *_LINES])


def registered() -> dict[str, Query]:
    return dict(_QUERIES)
