"""Groups of equal texts by skew-safe combining, with full contents compared at every stage.

Rows are dealt by the digest of their text without white space, and equality is decided on the content,
which is part of every grouping key:

    local    each task keeps one row a content (partial aggregation by digest, salt and content)
    salted   a hot digest's local winners meet in a few salted places, all other digests' in one
    global   the salt winners of hot digests are combined once more

So a text travels once, however many copies there are, and no place sees more rows of a content than
there are tasks. Rows meet their group on the digest. Where the contents showed that a digest names
several texts, the rows of that digest meet their groups on the content itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import SPACES, documents
from poolscope.session import settled

SALTS = 16
HEAVY = 1000
# An order of rows as one number: code points first, then 2^63 - doc_id (0 for a null id).
_IDS = "36893488147419103232BD"  # 2^65
_TOP = "9223372036854775808BD"  # 2^63


def squeezed(text: Column) -> Column:
    """The text without white space; empty for null."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def _contents(docs: DataFrame, digest: Callable[[Column], Column], carry: Sequence[str]) -> DataFrame:
    own = documents(docs, "doc_id", "text", whole=bool(carry))
    rows = own.withColumn("_content", squeezed(F.col("text")))
    length = "char_length(coalesce(text, ''))"
    place = f"CAST({length} AS DECIMAL(38, 0)) * {_IDS} + coalesce({_TOP} - doc_id, 0BD)"
    rows = rows.withColumn("_sha", F.unhex(F.sha2("_content", 256))).withColumn("_order", F.expr(f"CAST({place} AS DECIMAL(38, 0))"))
    carried = [F.struct(*[F.col("_whole")[c].alias(c) for c in carry]).alias("_carried")] if carry else []
    return rows.select("doc_id", "_sha", digest(F.col("_sha")).alias("_digest"), "_order", "_content", *carried)


def _combined(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """_digest, _best, _size of each group of equal contents; a digest comes twice if it names two."""
    best, size = F.max("_order").alias("_best"), F.count("*").alias("_size")
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_digest", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1)
    local = marked.select("_digest", salt.alias("_salt"), "_content", "_order")
    salted = local.groupBy("_digest", "_salt", "_content").agg(best, size)
    shown = F.when(F.col("_salt") >= 0, F.col("_content")).alias("_content")
    salted = settled(salted.select("_digest", "_salt", shown, "_best", "_size"))
    several = salted.where(F.col("_salt") >= 0).groupBy("_digest", "_content").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    alone = salted.where(F.col("_salt") < 0)
    return alone.select("_digest", "_best", "_size").unionByName(several.select("_digest", "_best", "_size"))


def exact_copies(
    docs: DataFrame, *, digest: Callable[[Column], Column] = lambda sha: sha, carry: Sequence[str] = (), heavy: int = HEAVY
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of documents, and the columns ``carry``.

    Texts are equal if they are so without white space; null is empty. The row with the most code points
    in its text stays, then the smallest doc_id (null last); of rows equal in both exactly one. So
    ``where("kept")`` holds each text once. ``digest`` shortens the SHA-256 that deals rows out; any
    function of it gives the same result. A digest with over a ``heavy``-th of all rows is hot: there are
    fewer than ``heavy`` of those, and their groups are sent to all tasks. ``carry`` names further columns
    of docs to return ("text" gives the texts); others are ignored whatever their names. Texts of any length
    are compared whole. An empty table gives an empty result. Runs jobs when called.
    """
    rows = _contents(docs, digest, carry)
    slim = settled(rows.drop("_content").withColumn("_row", F.monotonically_increasing_id()))
    total = slim.count()
    hot = settled(slim.groupBy("_digest").count().where(F.col("count") * heavy > total).select("_digest"))
    groups = settled(_combined(rows, hot))
    twice = settled(groups.groupBy("_digest").count().where("count > 1").select("_digest"))
    if not twice.isEmpty():
        # Unequal texts under one digest: their rows are dealt and joined by content.
        groups = groups.join(twice, "_digest", "left_anti")
        again = rows.select("_digest", "_content", "_order").join(twice, "_digest", "left_semi")
        named = again.groupBy("_digest", "_content").agg(F.max("_order").alias("_best"), F.count("*").alias("_size"))
        named = settled(named.withColumn("_sha", F.unhex(F.sha2("_content", 256))))
        every = rows.join(twice, "_digest", "left_semi").withColumn("_row", F.monotonically_increasing_id())
        found = [settled(every.join(named, ["_digest", "_sha", "_content"]).drop("_content"))]
        slim = slim.join(twice, "_digest", "left_anti")
    else:
        found = []
    marked = slim.join(F.broadcast(groups.join(hot, "_digest", "left_semi")), "_digest", "left")
    rest = marked.where(F.col("_best").isNull()).drop("_best", "_size").join(groups, "_digest")
    joined = reduce(DataFrame.unionByName, [marked.where(F.col("_best").isNotNull()), rest, *found])
    # Rows with the same text, length and id: the first of them stays.
    repeats = settled(reduce(DataFrame.unionByName, [f.select("_sha", "_order", "_row") for f in (slim, *found)])
                      .groupBy("_sha", "_order").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    first = joined.join(repeats, ["_sha", "_order"], "left")
    stays = (F.col("_order") == F.col("_best")) & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True))
    keep = F.expr(f"CASE WHEN _best % {_IDS} > 0 THEN CAST({_TOP} - _best % {_IDS} AS BIGINT) END")
    carried = [F.col("_carried")[c].alias(c) for c in carry]
    return first.select(
        "doc_id", keep.alias("keep_id"), F.col("_size").alias("group_size"), stays.alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), *carried,
    )


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content
  FROM documents
), placed AS (
  SELECT doc_id, content,
         first_value(doc_id) OVER best AS keep_id, row_number() OVER best = 1 AS kept,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM rows WINDOW best AS (PARTITION BY content ORDER BY size DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM placed
"""
