"""What several operators share: words, sums per document fold, Python workers, intermediate tables."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, and its complement for Java and Python patterns.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Spark's own limit of an Arrow batch, and what operators set in its place: a batch is held by the JVM and by the worker.
_SPARKS_BATCH, ARROW_BATCH = 64 << 20, 7_000_000
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return _words(text) if text else []


def words_on_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started.

    Arrow batches are kept to some ARROW_BATCH bytes, or one row; a limit that the session has been given stays.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit).rstrip("b") == str(_SPARKS_BATCH):
        spark.conf.set(limit, str(ARROW_BATCH))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # A pool of threads in each of an executor's workers would take more cores than the task has.
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        start = total = 0
        for row, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
            n = n or 0
            if row > start and total + n > most:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def release(*caches: dict) -> None:
    """For the end of a task: empties what a reused worker would carry into other stages, and hands free memory back."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim:  # of the C library on Linux; it keeps freed pieces otherwise
        _trim(0)


def documents(docs: DataFrame, *columns: str, whole: bool = False) -> DataFrame:
    """Only the wanted columns, text as string; with ``whole`` all of them as the struct _whole too.

    Extra columns of any name so never meet those that an operator adds.
    """
    wanted = [docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in columns]
    return docs.select(*wanted, *[F.struct(*[docs[c] for c in docs.columns]).alias("_whole")] * whole)
