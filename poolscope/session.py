"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_owners: list[list[str]] = []
#: Bytes of code beyond which HotSpot never compiles a method but interprets it, row by row.
_HUGE_METHOD = "8000"


def build_session(master: str | None = None, *, app: str = "poolscope", **conf: str) -> SparkSession:
    """Session with UTC time and strict (ANSI) arithmetic; other settings as given.

    The window tables are wide and one plan has more generated classes than Spark keeps by default
    (100), which would compile them anew for every query; the larger cache keeps them. See also :func:`keep_compiled`.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.codegen.cache.maxEntries": "2000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return keep_compiled(builder.getOrCreate())


def keep_compiled(spark: SparkSession) -> SparkSession:
    """The session, told not to fuse operators into methods that the JVM refuses to compile.

    The wide tables (46 to 300 columns) make such methods, and Spark's own limit is eight times the JVM's. Unfused, each
    operator's expressions are split into small methods. A limit that the session has been given stays.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, "65535") == "65535":
        spark.conf.set(limit, _HUGE_METHOD)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else a temporary one in local mode.

    The temporary one goes when the interpreter ends.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="poolscope-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back.

    For results that later steps read more than once: their lineage is computed once, survives the
    loss of executors, and later reads are columnar. Runs a job when called. The files belong to the
    innermost ``settling`` block, which deletes them when it ends; without one they stay.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settling(spark: SparkSession) -> Iterator[None]:
    """Owns the tables settled inside: write or collect results before the block ends, as it deletes them."""
    _owners.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _owners.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
