"""Exact quantiles and describe-style summaries without gathering the values anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.operators.joins import join_spread
from poolscope.operators.ordered import Running, running
from poolscope.session import settled

_MANTISSA = 2**36
_GROUP = 65_536
_BUCKET = 2**30


def sort_key(value: Column) -> Column:
    """Integer that orders doubles: binary exponent, then 36 bits of mantissa, with the sign.

    At most 65,536 different doubles share a key, so cutting the keys by powers of 65,536 gives groups
    of bounded size whatever the values are.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(F.greatest(size, F.lit(1e-300)))).cast("int")
    # log2 may round across a power of two; put the mantissa back into [1, 2).
    raw = size / F.pow(F.lit(2.0), guess)
    exponent = F.when(raw >= 2.0, guess + 1).when(raw < 1.0, guess - 1).otherwise(guess)
    mantissa = F.when(raw >= 2.0, raw / 2).when(raw < 1.0, raw * 2).otherwise(raw)
    key = (exponent.cast("bigint") + 1_100) * F.lit(_MANTISSA) + F.floor((mantissa - 1.0) * _MANTISSA).cast("bigint")
    return F.when(size < 1e-300, F.lit(0).cast("bigint")).otherwise(F.signum(value).cast("bigint") * key)


def _cut(key: Column, by: int) -> Column:
    return F.floor(key / F.lit(float(by))).cast("bigint")


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], *, part: Sequence[str]) -> DataFrame:
    """Exact quantiles per ``part`` with linear interpolation, as columns ``p<percent>``.

    Selection by radix: a first pass counts values by coarse sort key (exponent and 6 bits of mantissa, so a part
    has a bounded number of them, and partial counts leave few records to shuffle). The buckets that hold the wanted
    ranks are settled, a small table; a second pass keeps only the values inside them, counts equal ones before the
    shuffle and ranks the rest by the bounded prefix sums of :mod:`poolscope.operators.ordered`. Nulls are left
    out. Reads ``df`` twice and runs a job when called, for the buckets.
    """
    part = list(part)
    ranks = [F.lit(float(p)) * (F.col("_total") - 1) for p in probabilities]
    ends = [end(rank) for rank in ranks for end in (F.floor, F.ceil)]
    rows = df.where(F.col(value).isNotNull()).select(*part, F.col(value).alias("_value"))
    rows = rows.withColumn("_bucket", _cut(sort_key(F.col("_value")), _BUCKET))

    whole = Window.partitionBy(*part)
    buckets = rows.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = buckets.select(
        "*",
        F.sum("_n").over(whole).alias("_total"),
        (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    holds = [(F.col("_before") <= end) & (end < F.col("_before") + F.col("_n")) for end in ends]
    wanted = settled(buckets.where(reduce(or_, holds)).drop("_n"))

    # The partition's number spreads rows of one value too, should the buckets be too many for Spark to send to all tasks.
    inside = join_spread(rows, wanted, [*part, "_bucket"], spread=[F.spark_partition_id(), F.col("_value")], how="inner")
    counts = inside.groupBy(*part, "_bucket", "_before", "_total", "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(
        counts.withColumn("_key", sort_key(F.col("_value"))),
        [Running("sum", F.col("_n"), upto="_inside")],
        part=[*part, "_bucket"],
        order=["_value"],
        levels=[[("_key", F.col("_key"))], [("_high", _cut(F.col("_key"), _GROUP))]],
    ).withColumn("_upto", F.col("_before") + F.col("_inside"))
    found = []
    for p, rank in zip(probabilities, ranks, strict=True):
        low, high = F.floor(rank), F.ceil(rank)
        at = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)
        below, above = (F.max(F.when(at(place), F.col("_value"))) for place in (low, high))
        found.append((below + (above - below) * F.max(rank - low)).alias(f"p{100 * p:g}"))
    return ranked.groupBy(*part).agg(*found)


def describe(
    df: DataFrame,
    columns: Sequence[str],
    *,
    part: Sequence[str] = ("market_id",),
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    ready: bool = False,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles of several columns per ``part``.

    The columns are settled first (see :func:`poolscope.session.settled`), as they are read for the
    counts and twice for the ranks; with ``ready`` the caller has done so. Runs jobs when called.
    """
    part = list(part)
    df = df.select(*part, *columns)
    df = df if ready else settled(df)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(*part, f"stack({len(columns)}, {pairs}) AS (metric, value)")
    # x + 0 folds negative zero into zero, so both count as one value.
    long = long.where("value IS NOT NULL").withColumn("value", F.col("value") + F.lit(0.0))
    keys = [*part, "metric"]
    basic = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basic.join(quantiles(long, "value", probabilities, part=keys), keys)
