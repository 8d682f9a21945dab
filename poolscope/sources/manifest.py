"""Manifest of an ingest run (JSON lines): which block ranges were fetched, and whether any are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.operators.ordered import Running, running

MANIFEST = (
    "from_block bigint, to_block bigint, status string, attempts bigint, error string, logs bigint,"
    " decoded bigint, shards bigint, updated_at double, filtered bigint"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines of one or many runs, with the file they come from as ``run``."""
    return spark.read.schema(MANIFEST).json(path).withColumn("run", F.col("_metadata.file_name"))


def manifest_audit(manifest: DataFrame) -> DataFrame:
    """Per run: attempts by status, what the finished ranges add up to, and gaps between them."""
    done = manifest.where("status = 'done'").select("run", "from_block", "to_block", "logs", "shards")
    # Ranges of one run, cut into stretches of blocks so that a long run is not one task's work.
    chained = running(
        done,
        [Running("row", F.col("to_block"), before="_before")],
        part=["run"],
        order=["from_block"],
        levels=[[("_stretch", F.expr("from_block div 1000000"))]],
    )
    finished = chained.groupBy("run").agg(
        F.min("from_block").alias("first_block"),
        F.max("to_block").alias("last_block"),
        F.sum(F.col("to_block") - F.col("from_block") + 1).alias("blocks"),
        F.sum("logs").alias("logs"),
        F.sum("shards").alias("shards"),
        F.count_if(F.col("from_block") != F.col("_before") + 1).alias("gaps"),
    )
    status = manifest.groupBy("run").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("started", "done", "failed")]
    )
    return status.join(finished, "run", "left")
