"""Column contracts of the raw event tables and of every derived frame."""

from __future__ import annotations

from pyspark.sql import types as T

SECONDS_PER_YEAR = 31_536_000

# The eight event kinds, with the raw column that holds the amount.
AMOUNT_COLUMN = {
    "AccrueInterest": "interest",
    "Borrow": "assets",
    "Liquidate": "repaidAssets",
    "Repay": "assets",
    "Supply": "assets",
    "SupplyCollateral": "assets",
    "Withdraw": "assets",
    "WithdrawCollateral": "assets",
}
EVENTS = tuple(AMOUNT_COLUMN)

# Sign of an event's amount in (supply, borrow, collateral).
SIGNS = {
    "AccrueInterest": (1, 1, 0),
    "Borrow": (0, 1, 0),
    "Liquidate": (0, -1, 0),
    "Repay": (0, -1, 0),
    "Supply": (1, 0, 0),
    "SupplyCollateral": (0, 0, 1),
    "Withdraw": (-1, 0, 0),
    "WithdrawCollateral": (0, 0, -1),
}

AGGREGATED = "Aggregated"


def _struct(*fields: tuple[str, str, bool]) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "bigint": T.LongType(),
        "double": T.DoubleType(),
        "tinyint": T.ByteType(),
    }
    return T.StructType([T.StructField(n, kinds[k], nullable) for n, k, nullable in fields])


_BASE = [
    ("id", "string", False),
    ("block_number", "bigint", False),
    ("log_index", "bigint", False),
    ("block_timestamp", "bigint", False),
    ("tx_hash", "string", False),
]


def event_schema(event: str) -> T.StructType:
    """Declared schema of one raw event table."""
    if event not in AMOUNT_COLUMN:
        raise ValueError(f"unknown event {event!r}; expected one of {EVENTS}")
    extra = ["prevBorrowRate"] if event == "AccrueInterest" else []
    extra.append(AMOUNT_COLUMN[event])
    return _struct(*_BASE, *[(name, "string", False) for name in extra])


def all_events_schema() -> T.StructType:
    """The columns of all kinds side by side, for a scan of all event tables at once."""
    extra = ["prevBorrowRate", *dict.fromkeys(AMOUNT_COLUMN.values())]
    return _struct(*_BASE, *[(name, "string", True) for name in extra])


_KEYS = [("market_id", "string", False), *_BASE[1:], ("event_type", "string", False)]
_DELTAS = [
    ("delta_supply_assets", "bigint", False),
    ("delta_borrow_assets", "bigint", False),
    ("delta_collateral_assets", "bigint", False),
]

RAW_LEDGER = _struct(*_KEYS, *_DELTAS, ("borrow_rate_per_sec", "double", True))

LEDGER = _struct(
    *_KEYS,
    *_DELTAS,
    ("total_supplied_assets", "bigint", False),
    ("outstanding_borrow_assets", "bigint", False),
    ("total_collateral_assets", "bigint", False),
    ("borrow_rate_per_sec", "double", True),
    ("utilization_rate", "double", False),
    ("borrow_apy", "double", True),
    ("supply_rate_per_sec", "double", True),
    ("supply_apy", "double", True),
    ("delta_utilization", "double", False),
    ("delta_borrow_apy", "double", True),
    ("delta_supply_apy", "double", True),
)

# Event type, delta column and sign behind each flow total (None: any sign, as is).
FLOW_RULES = {
    "supply_in_assets": ("Supply", "delta_supply_assets", 1),
    "withdraw_out_assets": ("Withdraw", "delta_supply_assets", -1),
    "borrow_in_assets": ("Borrow", "delta_borrow_assets", 1),
    "repay_out_assets": ("Repay", "delta_borrow_assets", -1),
    "liquidate_repay_assets": ("Liquidate", "delta_borrow_assets", -1),
    "interest_assets": ("AccrueInterest", "delta_borrow_assets", None),
    "collateral_in_assets": ("SupplyCollateral", "delta_collateral_assets", 1),
    "collateral_out_assets": ("WithdrawCollateral", "delta_collateral_assets", -1),
}
FLOW_TOTALS = list(FLOW_RULES)

AGGREGATED_LEDGER = T.StructType(
    LEDGER.fields
    + [T.StructField(n, T.LongType(), False) for n in [*FLOW_TOTALS, "event_count"]]
)

INDICATOR_WINDOWS = {"5min": 300, "1h": 3_600, "6h": 21_600}

ATTRIBUTION_WINDOWS = {
    "5min": 300,
    "1h": 3_600,
    "6h": 21_600,
    "24h": 86_400,
    "7d": 604_800,
    "30d": 2_592_000,
    "90d": 7_776_000,
    "365d": 31_536_000,
}


#: What sums of amounts are held in, and the widest type an amount may have.
WIDE = "decimal(38,0)"
_AMOUNTS = {f.name for f in AGGREGATED_LEDGER.fields if isinstance(f.dataType, T.LongType)} - {
    "block_number", "log_index", "block_timestamp", "event_count"} | {"headroom_u90_assets", "headroom_u95_assets"}


def amount_type_of(ledger) -> T.DataType:
    """The type of a ledger's amounts."""
    return ledger.schema["delta_supply_assets"].dataType


def with_amounts(schema: T.StructType, amount_type: T.DataType) -> T.StructType:
    """The schema with whole-number amounts in another type."""
    return T.StructType([
        T.StructField(f.name, amount_type if f.name in _AMOUNTS and isinstance(f.dataType, T.LongType) else f.dataType, f.nullable)
        for f in schema.fields
    ])


def indicator_schema(windows: dict[str, int] | None = None) -> T.StructType:
    """The ledger's 20 columns and the engineered features (39 for the default three windows)."""
    labels = list(windows or INDICATOR_WINDOWS)
    doubles = ["borrow_apr", "borrow_in_assets", "borrow_out_assets", "supply_in_assets",
               "supply_out_assets", "interest_assets"]
    for stem in ("util", "borrow_apr"):
        doubles += [f"{stem}_{stat}_{label}" for label in labels for stat in ("mean", "std")]
    doubles += [
        f"{flow}_intensity_{label}"
        for label in labels
        for flow in ("borrow", "repay", "supply", "withdraw", "interest")
    ]
    doubles += ["delta_borrow_apr", "elasticity_apr_per_util"]
    extra = [(n, "double", False) for n in doubles]
    extra += [(f"regime_util_gt_{p}", "tinyint", False) for p in (90, 95, 99)]
    if "6h" in labels:
        extra.append(("borrow_apr_6h_avg_ui", "double", False))
    return T.StructType(LEDGER.fields + _struct(*extra).fields)


ATTRIBUTION_CORE = T.StructType(
    LEDGER.fields
    + _struct(
        ("borrow_apr", "double", False),
        ("buffer", "double", False),
        ("headroom_u90_assets", "bigint", False),
        ("headroom_u95_assets", "bigint", False),
        *[
            (n, "double", False)
            for n in (
                "borrow_in_assets",
                "repay_out_assets",
                "liquidate_repay_assets",
                "supply_in_assets",
                "withdraw_out_assets",
                "interest_assets",
                "net_borrow_principal_assets",
                "net_supply_assets",
                "contrib_u_from_borrow",
                "contrib_u_from_repay",
                "contrib_u_from_liquidate",
                "contrib_u_from_withdraw",
                "contrib_u_from_supply",
                "contrib_u_from_interest",
                "delta_u_pred",
                "delta_u_real",
                "delta_u_residual",
                "delta_borrow_apr",
            )
        ],
        ("irm_slope", "double", True),
        ("irm_response_to_withdraw", "double", True),
        ("irm_response_to_repay", "double", True),
        ("irm_response_to_liquidate", "double", True),
    ).fields
)
