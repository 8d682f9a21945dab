"""Removal of lines that many documents repeat, by levelled sorted runs of line hashes.

A run holds one entry per line key: its hash, the number of documents that have it, the largest of
their ids. Runs are bucketed and sorted by hash. A new batch of documents is one run of level 0; as
soon as a level has ``fanout`` runs they are merged into one of the next, so each entry is rewritten
once a level. Since a document lies in one batch, counts of runs add up. A batch meets the runs in a
merge join on the hash, for which only the batch is shuffled. Everything is a DataFrame plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm.common import SPACES, documents
from poolscope.session import settled, shared_folder

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FANOUT = 4
HEAVY = 1000
ENTRY = "h1 long, h2 long, n_docs long, last_doc long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACES)), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, row, at, h1, h2 for each line whose key is long enough; two hashes make 128 bits.

    (doc, row) names a row of documents by id and text, so that rows that share an id stay apart.
    """
    lines = docs.select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"),
        F.xxhash64("text").alias("row"),
        F.posexplode(_lines(F.col("text"))).alias("at", "line"),
    )
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    return keyed.select("doc", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The runs of all batches so far. ``add`` and ``unseen`` take line hashes of one batch."""

    def __init__(self, spark: SparkSession, *, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, entries: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (entries.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{shared_folder(self.spark)}/{name}").format("parquet").saveAsTable(name))
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        if len(runs) == 1:
            return self.spark.table(runs[0])
        # Files, not tables: over a union of bucketed scans Spark 4.1 leaves out the shuffle but not the
        # rule that turns bucketing off, so entries of one key would not meet.
        every = self.spark.read.schema(ENTRY).parquet(*[f"{shared_folder(self.spark)}/{name}" for name in runs])
        return every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> None:
        """A new run of level 0; full levels are merged upwards. Runs jobs."""
        of_doc = lines.select("h1", "h2", "doc").distinct()
        run = of_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        name, level = self._write(run), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            name, level = self._write(self._merged(full)), level + 1
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")  # the files stay until the shared folder is cleared

    def entries(self) -> DataFrame:
        """h1, h2, n_docs, last_doc over all batches added."""
        return self._merged([name for level in self.levels for name in level])

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines that no batch added so far has: a merge anti-join with each run."""
        for name in [name for level in self.levels for name in level]:
            lines = lines.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        return lines

    def repeated(self, lines: DataFrame, least_docs: int) -> DataFrame:
        """The lines found in at least ``least_docs`` documents, except in the largest id of them.

        Keys with over a ``HEAVY``-th of all occurrences, of which there are fewer than HEAVY, are sent to
        all tasks; so no key's lines meet in one task. All others meet their runs in a merge join.
        """
        many = self.entries().where(F.col("n_docs") >= least_docs)
        total = many.agg(F.sum("n_docs")).first()[0] or 0
        heavy = many.where(F.col("n_docs") * HEAVY > total).select("h1", "h2", F.col("last_doc").alias("_last"))
        marked = lines.join(F.broadcast(heavy), ["h1", "h2"], "left")
        rare = many.where(F.col("n_docs") * HEAVY <= total).select("h1", "h2", "last_doc")
        rest = marked.where(F.col("_last").isNull()).join(rare, ["h1", "h2"]).where(F.col("doc") < F.col("last_doc"))
        return marked.where(F.col("doc") < F.col("_last")).select("doc", "row", "at").unionByName(rest.select("doc", "row", "at"))


def dedup_lines(
    docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """The rows of documents with their repeated lines removed: all columns, text replaced, plus n_lines and n_dropped.

    A key of at least ``least_chars`` code points found in at least ``least_docs`` documents loses all its
    lines but those in the largest doc_id holding it. Null or empty text is one empty line and becomes
    empty text; a text that loses all lines becomes empty. Rows with the same doc_id count as one
    document; a null doc_id counts as one document below all ids. Columns of docs named n_lines or
    n_dropped are replaced. Empty tables give an empty result. Runs jobs when called.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    # A key's hashes are read twice, here for the runs and below for the join.
    own = documents(docs, "doc_id", "text", whole=True)
    hashes = settled(line_hashes(own, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches))))
    runs = LineRuns(spark, fanout=fanout)
    for batch in range(batches):
        runs.add(hashes.where(F.col("batch") == batch))
    gone = runs.repeated(hashes, least_docs).groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row"))
    gone = gone.agg(F.collect_set("at").alias("_gone"))
    same = (F.coalesce(own["doc_id"], F.lit(_NO_ID)) == gone["_doc"]) & (F.xxhash64(own["text"]) == gone["_row"])
    both = own.select("doc_id", "text", "_whole").join(gone, same, "left").withColumn("_lines", _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(rest)
    fields = [text.alias(c) if c == "text" else F.col("_whole")[c].alias(c) for c in docs.columns]
    return both.select(
        *fields,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: n_dropped and the kept text's hash, as DuckDB computes them.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), many AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, last_doc IS NOT NULL AND doc_id < last_doc AS gone
  FROM keyed LEFT JOIN many USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
