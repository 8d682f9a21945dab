"""Event tables as Parquet shards, one folder per event kind."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.schemas import EVENTS, all_events_schema, event_schema


@dataclass(frozen=True)
class EventStore:
    """Reads event tables under ``root``.

    ``layout`` is the path of one event kind below the root; the default is the fetcher's own,
    ``root`` being the protocol's folder (the parent of ``market``).
    """

    spark: SparkSession
    root: str
    layout: str = "market/shards/{event}/shard_*.parquet"
    allow_missing: bool = True

    def path(self, event: str) -> str:
        event_schema(event)
        return self._glob(event)

    def _glob(self, event: str) -> str:
        return f"{self.root.rstrip('/')}/{self.layout.format(event=event)}"

    def read(
        self,
        event: str,
        *,
        market_ids: str | Iterable[str] | None = None,
        id_col: str = "id",
        columns: str | Iterable[str] = "*",
        extra_where: str = "",
        extra_args: Sequence[object] = (),
    ) -> DataFrame:
        """Scan one event kind.

        The market filter, the columns and ``extra_where`` (an SQL predicate with ``?`` markers bound
        to ``extra_args``) all reach the Parquet scan. A kind without files is an empty table unless
        ``allow_missing`` is off.
        """
        schema = event_schema(event)
        try:
            df = self.spark.read.schema(schema).parquet(self.path(event))
        except AnalysisException as problem:
            if not self.allow_missing or problem.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], schema)
        if market_ids is not None:
            ids = [market_ids] if isinstance(market_ids, str) else list(market_ids)
            df = df.where(F.col(id_col).isin(ids))
        if extra_where:
            df = self.spark.sql(
                f"SELECT * FROM {{events}} WHERE {extra_where}", args=list(extra_args), events=df
            )
        wanted = [columns] if isinstance(columns, str) else list(columns)
        return df.select(*wanted)

    def read_together(self, market_ids: str | Iterable[str] | None = None) -> DataFrame:
        """All eight event kinds in one scan, with the kind (from the file's folder) as ``event_type``.

        The same rows as :meth:`read_all`, for the pipelines: one scan keeps the plan eight times
        smaller. A kind's own columns are null on the other kinds' rows.
        """
        schema = all_events_schema()
        try:
            df = self.spark.read.schema(schema).parquet(self._glob(f"{{{','.join(EVENTS)}}}"))
        except AnalysisException as problem:
            if not self.allow_missing or problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema.add("event_type", "string"))
        folders = self.layout.split("/")
        place = next(k for k, f in enumerate(folders) if "{event}" in f)
        before, after = folders[place].split("{event}")
        folder = F.substring_index(
            F.substring_index(F.col("_metadata.file_path"), "/", place - len(folders)), "/", 1
        )
        kind = F.substring(folder, F.lit(len(before) + 1), F.length(folder) - len(before) - len(after))
        df = df.withColumn("event_type", kind)
        if market_ids is not None:
            ids = [market_ids] if isinstance(market_ids, str) else list(market_ids)
            df = df.where(F.col("id").isin(ids))
        return df

    def read_all(self, market_ids: str | Iterable[str] | None = None) -> dict[str, DataFrame]:
        """All eight event tables, for some markets or for all of them."""
        ids = market_ids if market_ids is None or isinstance(market_ids, str) else list(market_ids)
        return {event: self.read(event, market_ids=ids) for event in EVENTS}


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a result queryable by name in ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df


def write_features(df: DataFrame, path: str, *, mode: str = "errorifexists", by_market: bool = False) -> None:
    """Write a result as snappy Parquet; ``by_market`` lays it out in one folder per market."""
    writer = df.write.mode(mode).option("compression", "snappy")
    if by_market:
        writer = writer.partitionBy("market_id")
    writer.parquet(path)


def write_ordered(df: DataFrame, path: str, *, files: int, mode: str = "errorifexists") -> None:
    """Write a ledger in its order (market, block, log) as snappy Parquet: each file is sorted, and files follow each other.

    The bounds between ``files`` are sampled over the whole order, so a market with most of the rows is spread over most
    of the files.
    """
    order = ["market_id", "block_number", "log_index"]
    placed = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    write_features(placed, path, mode=mode)
