"""Lending events derived from the `events` table, written once as real event tables.

The rule is a fixed mapping of event rows to the eight kinds; the DuckDB twin is in `oracles.py`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.session import keep_compiled, shared_folder
from poolscope.sources.events import EventStore

# Event kind by event_id % 8.
KINDS = ("Supply", "Borrow", "Withdraw", "Repay", "Liquidate", "AccrueInterest",
         "SupplyCollateral", "WithdrawCollateral")

_written: dict[tuple[str, str], EventStore] = {}


def lending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lending events in one frame, amounts as decimal or hex strings."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Plain wall-clock arithmetic: the result does not depend on the session's time zone.
    sec = F.expr(
        "cast(cast(cast(ts as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as bigint)"
    )
    df = events.select(
        "event_id", "user_id",
        sec.alias("sec"),
        F.round(F.col("value") * 100).cast("bigint").alias("a"),
        (F.col("event_id") % 8).alias("k"),
    )
    amount = F.expr(
        """CASE k WHEN 0 THEN 1000 * a
                  WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 300 * a ELSE 550 * a END
                  WHEN 2 THEN 400 * a WHEN 3 THEN 120 * a WHEN 4 THEN 60 * a
                  WHEN 5 THEN a WHEN 6 THEN 500 * a ELSE 200 * a END"""
    )
    df = df.withColumn("amount", amount)
    text = F.when(
        F.col("event_id") % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex("amount")))
    ).otherwise(F.col("amount").cast("string"))
    return df.select(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("k") + 1).cast("int")).alias("event"),
        F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("id"),
        F.expr("sec div 240").alias("block_number"),
        F.col("event_id").alias("log_index"),
        F.expr("sec div 240 * 240").alias("block_timestamp"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("tx_hash"),
        F.when(F.col("k") == 4, text).alias("repaidAssets"),
        F.when(F.col("k") == 5, text).alias("interest"),
        F.when(
            F.col("k") == 5, (F.lit(1_000_000_000) + 30_000_000 * (F.col("event_id") % 50)).cast("string")
        ).alias("prevBorrowRate"),
        F.when(~F.col("k").isin(4, 5), text).alias("assets"),
    )


def event_store(spark: SparkSession, sf_dir: str) -> EventStore:
    """Event tables of one data folder, written on first use into the shared folder."""
    keep_compiled(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        tag = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
        root = f"{shared_folder(spark)}/lending-events-{tag}"
        lending_events(spark, sf_dir).write.mode("overwrite").partitionBy("event").parquet(root)
        _written[key] = EventStore(spark, root, layout="event={event}/*.parquet")
    return _written[key]
