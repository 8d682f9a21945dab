"""Contracts as data: which rule of a table is broken, and by how many rows.

A contract is a list of rules: some are about the schema and known before any row is read, the others count
the rows that break them. All counts of a contract are one aggregation, so they can be a report of their own
(:func:`contract_report`) or be observed in the pass that writes the table (:func:`write_checked`), without
a job of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.schemas import ATTRIBUTION_CORE, LEDGER, RAW_LEDGER, event_schema, indicator_schema
from poolscope.sources.events import write_features

TOLERANCE = 1e-12


@dataclass(frozen=True)
class Rule:
    """``broken`` is SQL that is true for a row which breaks the rule; a rule on the schema has its count in ``known``."""

    name: str
    broken: str | None = None
    known: int | None = None

    def violations(self) -> Column:
        if self.known is not None:
            return F.max(F.lit(self.known).cast("bigint"))
        return F.count_if(F.expr(self.broken))


def _is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.LongType, T.IntegerType)) or isinstance(kind, T.DecimalType) and kind.scale == 0


def contract(
    df: DataFrame, expected: T.StructType, *, allow_extra: bool = False, in_order: bool = False, bounded: Sequence[str] = (),
    nullable: Sequence[str] = (),
) -> list[Rule]:
    """The rules of a table with the columns of ``expected``.

    Missing, extra and misplaced columns; whole-number columns that are not; nulls in the columns that
    ``expected`` declares without (but for ``nullable``); shares in ``bounded`` that are undefined or outside
    [0, 1] by more than 1e-12. Rules on the rows of a missing column are left out, as missing_columns counts it.
    """
    missing = [c for c in expected.names if c not in df.columns]
    extra = [c for c in df.columns if c not in expected.names]
    own = [c for c in df.columns if c in expected.names]
    whole = [f.name for f in expected.fields if f.name in own and _is_whole(f.dataType)]
    rules = [
        Rule("missing_columns", known=len(missing)),
        Rule("extra_columns", known=0 if allow_extra else len(extra)),
        Rule("misplaced_columns", known=int(in_order and own != [c for c in expected.names if c in own])),
        Rule("not_whole_columns", known=sum(not _is_whole(df.schema[c].dataType) for c in whole)),
    ]
    filled = [f.name for f in expected.fields if not f.nullable and f.name in own and f.name not in nullable]
    rules += [Rule(f"null_{c}", f"`{c}` IS NULL") for c in filled]
    return rules + [
        Rule(f"bounds_{c}", f"`{c}` IS NULL OR isnan(`{c}`) OR `{c}` < -{TOLERANCE} OR `{c}` > 1 + {TOLERANCE}") for c in bounded if c in own
    ]


def event_contract(df: DataFrame, event: str) -> list[Rule]:
    return contract(df, event_schema(event), allow_extra=True)


def raw_ledger_contract(df: DataFrame) -> list[Rule]:
    return contract(df, RAW_LEDGER, in_order=True)


#: Null before a market's first interest event unless ``leading_rate`` says otherwise.
_RATES = ("borrow_rate_per_sec", "borrow_apy", "supply_rate_per_sec", "supply_apy", "delta_borrow_apy", "delta_supply_apy")


def ledger_contract(df: DataFrame) -> list[Rule]:
    return contract(df, LEDGER, allow_extra=True, bounded=["utilization_rate"], nullable=_RATES)


def indicator_contract(df: DataFrame, windows: dict[str, int] | None = None) -> list[Rule]:
    schema = indicator_schema(windows)
    rates = [c for c in schema.names if c.startswith(("borrow_apr", "delta_borrow_apr", "elasticity"))]
    return contract(df, schema, bounded=["utilization_rate"], nullable=[*_RATES, *rates])


def attribution_contract(df: DataFrame) -> list[Rule]:
    return contract(df, ATTRIBUTION_CORE, allow_extra=True, bounded=["utilization_rate"], nullable=[*_RATES, "borrow_apr", "delta_borrow_apr"])


def _metrics(rules: Sequence[Rule]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *[r.violations().alias(r.name) for r in rules]]


def contract_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, rows, violations, passed for each rule, and the rule ``no_rows``, in one pass over the table."""
    one = df.agg(*_metrics(rules))
    lines = [F.struct(F.lit("no_rows").alias("rule"), (F.col("rows") == 0).cast("bigint").alias("violations"))]
    # Of a table without rows the schema is still known.
    known = lambda r: F.lit(r.known).cast("bigint") if r.known is not None else F.col(r.name)
    lines += [F.struct(F.lit(r.name).alias("rule"), known(r).alias("violations")) for r in rules]
    return one.select("rows", F.inline(F.array(*lines))).select("rule", "rows", "violations", (F.col("violations") == 0).alias("passed"))


def write_checked(df: DataFrame, path: str, rules: Sequence[Rule], *, refuse_schema: bool = True, **options) -> dict[str, int]:
    """Writes the table and returns the broken rules with their counts, seen while it was written.

    A schema that breaks a rule raises before the write, unless ``refuse_schema`` is off; rows that break one are
    written and reported, so the caller decides. ``options`` are those of ``write_features``.
    """
    wrong = {r.name: r.known for r in rules if r.known}
    if wrong and refuse_schema:
        raise ValueError(f"{path}: not written, the columns break {wrong}")
    seen = Observation()
    counted = [r for r in rules if r.known is None]
    write_features(df.observe(seen, *_metrics(counted)), path, **options)
    found = seen.get
    broken = {r.name: found[r.name] for r in counted if found[r.name]}
    return wrong | ({"no_rows": 1} if not found["rows"] else {}) | broken
