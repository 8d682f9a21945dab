"""Eight raw event tables to one signed-delta ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.functions import base_units, rate_per_second
from poolscope.schemas import AMOUNT_COLUMN, EVENTS, RAW_LEDGER, SIGNS

_DELTAS = ("delta_supply_assets", "delta_borrow_assets", "delta_collateral_assets")
_POSITION = ("block_number", "log_index", "block_timestamp")


def _tagged(df: DataFrame, event: str) -> DataFrame:
    """One event table in the common shape: amount still as text, with the event's signs."""
    amount = AMOUNT_COLUMN[event]
    sets_rate = event == "AccrueInterest"
    wanted = ["id", *_POSITION, "tx_hash", amount, *(["prevBorrowRate"] if sets_rate else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"{event}: missing columns {missing}")
    signs = [f"{s} AS _sign{k}" for k, s in enumerate(SIGNS[event])]
    return df.selectExpr(
        "id AS market_id",
        *[f"CAST({c} AS BIGINT) AS {c}" for c in _POSITION],
        "tx_hash",
        f"'{event}' AS event_type",
        f"'{event}.{amount}' AS _source",
        f"CAST({amount} AS STRING) AS _amount",
        *signs,
        f"{sets_rate} AS _sets_rate",
        f"CAST({'prevBorrowRate' if sets_rate else 'NULL'} AS DOUBLE) AS _rate",
    )


def _signed(tagged: DataFrame, amount_type: str) -> DataFrame:
    """Ledger rows: the parsed amount under each total's sign, and the rate where the event sets one."""
    parsed = tagged.withColumn(
        "_amount", base_units(F.col("_amount"), name=F.col("_source"), amount_type=amount_type)
    )
    return parsed.select(
        "market_id", *_POSITION, "tx_hash", "event_type",
        *[(F.col("_amount") * F.col(f"_sign{k}")).cast(amount_type).alias(d) for k, d in enumerate(_DELTAS)],
        F.when(F.col("_sets_rate"), rate_per_second(F.col("_rate"))).alias("borrow_rate_per_sec"),
    ).select(*RAW_LEDGER.names)


def standardize_event(df: DataFrame, event: str, *, amount_type: str = "bigint") -> DataFrame:
    """Ledger rows of one event table."""
    return _signed(_tagged(df, event), amount_type)


def raw_ledger_together(events: DataFrame, *, amount_type: str = "bigint") -> DataFrame:
    """The ledger from one frame of all kinds, tagged with ``event_type``."""
    pick = lambda values: "CASE event_type " + " ".join(f"WHEN '{e}' THEN {v}" for e, v in values.items()) + " END"
    tagged = events.selectExpr(
        "id AS market_id",
        *_POSITION,
        "tx_hash",
        "event_type",
        f"{pick({e: repr(f'{e}.{a}') for e, a in AMOUNT_COLUMN.items()})} AS _source",
        f"{pick(AMOUNT_COLUMN)} AS _amount",
        *[f"{pick({e: s[k] for e, s in SIGNS.items()})} AS _sign{k}" for k in range(len(_DELTAS))],
        "event_type = 'AccrueInterest' AS _sets_rate",
        "CAST(prevBorrowRate AS DOUBLE) AS _rate",
    )
    return _signed(tagged, amount_type)


def raw_ledger(
    events: dict[str, DataFrame], *, spark: SparkSession | None = None, amount_type: str = "bigint"
) -> DataFrame:
    """Bag union of the standardized event tables.

    The ledger order is (block_number, log_index) per market; it is carried by those columns and by
    every operator that needs it, so no sort is done here. Event kinds left out count as empty; with
    none at all the result is an empty ledger.
    """
    unknown = set(events) - set(EVENTS)
    if unknown:
        raise ValueError(f"unknown events {sorted(unknown)}")
    parts = [_tagged(events[e], e) for e in EVENTS if e in events]
    if not parts:
        session = spark or SparkSession.getActiveSession()
        return session.createDataFrame([], RAW_LEDGER)
    return _signed(reduce(DataFrame.unionByName, parts), amount_type)
