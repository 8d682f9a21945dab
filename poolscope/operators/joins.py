"""Join of rows with a small per-group table when one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def join_spread(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], *, spread: Sequence[Column], how: str = "left"
) -> DataFrame:
    """``rows`` joined with one ``groups`` row per key.

    Each group's rows are spread over 64 salted copies of its key by a hash of ``spread``, so a group
    that holds a third of all rows does not land in one task. Spark still broadcasts ``groups`` if it
    is below its own size limit.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
