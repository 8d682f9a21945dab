"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by the hash of their id, and the source's quota is a number of
whole passes over its blocks and a part of one more, in hash order. A binary tree splits the quotas of
block copies among output shards: each node draws how many of each source's copies go left, from the
multivariate hypergeometric distribution, so shards are of equal size and exactly exhaust the quotas.
Each source's copies, permuted by hash, are then dealt out by these counts; rows of a shard are ordered
by hash. All of it is columns and expressions; only tables of sources and blocks, of fixed size per
source, are aggregated across shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.common import WORD, documents
from poolscope.session import settled

BLOCKS = 1024
SHARDS = 16
MOST_PASSES = 3
BROADCAST_BLOCKS = 100_000
SEED = 7
PIECE_WORDS = 4_000_000


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows with _size (words), _key (source, null apart), _order (hash of the id) and _block."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    name = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))  # "seed:id" is hashed, so another seed is another order
    return docs.withColumns({
        "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_key": F.when(docs["source"].isNull(), "n").otherwise(F.concat(F.lit("s"), docs["source"].cast("string"))),
        "_order": F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")),
    }).withColumn("_block", (F.conv(F.substring("_order", 1, 4), 16, 10).cast("int") * BLOCKS / 65536).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """_key, source_size, target, and the quota in words as whole passes and a rest.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A source at its cap of three times its
    size leaves the rest to the others: with sources by cap over weight, the level that the uncapped
    ones share is the largest of (total - caps before) / (weights from here on).
    """
    sources = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("_key") == "n", "_key"))
    weighed = sources.withColumn("_weight", (rank - 1) % 3 + 1).withColumn("_cap", MOST_PASSES * F.col("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy(F.col("_cap") / F.col("_weight"), "_key")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    levelled = weighed.withColumn("_at", left.cast("double") / F.sum("_weight").over(onward))
    shared = F.max("_at").over(everything) * F.col("_weight")
    out = levelled.withColumn("target", F.least(F.col("_cap").cast("double"), shared))
    quota = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    return out.select("_key", "source_size", "target", passes.cast("int").alias("_passes"),
                      (quota - passes * F.col("source_size")).cast("long").alias("_rest"))


def _hypergeometric(u: str, pool: str, of_kind: str, draws: str) -> str:
    """SQL: how many of ``draws`` from ``pool`` are of a kind that has ``of_kind``; u is uniform in [0, 1).

    Inverse transform that starts at the mode, where weights are relative to it, and walks up, then down.
    """
    up = "slice(sequence(p.mode, p.hi), 2, p.hi - p.mode)"
    down = "slice(sequence(p.mode, p.lo), 2, p.mode - p.lo)"
    rise = "((p.kind - k + 1D) * (p.n - k + 1D) / (k * (p.pool - p.kind - p.n + k)))"
    fall = "((k + 1D) * (p.pool - p.kind - p.n + k + 1D) / ((p.kind - k) * (p.n - k)))"
    total = "aggregate({0}, named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * {1}, 's', a.s + a.w * {1}), a -> a.s)"
    walk = ("aggregate({0}, named_struct('w', 1D, 's', {2}, 'k', CAST(NULL AS BIGINT)), (a, k) -> named_struct("
            "'w', a.w * {1}, 's', a.s + a.w * {1}, 'k', coalesce(a.k, if(a.s + a.w * {1} >= p.t, k, NULL))))")
    bounds = (f"named_struct('u', {u}, 'pool', {pool}, 'kind', {of_kind}, 'n', {draws}, "
              f"'lo', greatest(0L, {draws} + {of_kind} - {pool}), 'hi', least({draws}, {of_kind}))")
    mode = ("named_struct('u', b.u, 'pool', b.pool, 'kind', b.kind, 'n', b.n, 'lo', b.lo, 'hi', b.hi, "
            "'mode', least(b.hi, greatest(b.lo, CAST(floor((b.n + 1D) * (b.kind + 1D) / (b.pool + 2D)) AS BIGINT))))")
    scaled = ("named_struct('pool', p.pool, 'kind', p.kind, 'n', p.n, 'lo', p.lo, 'hi', p.hi, 'mode', p.mode, "
              f"'t', p.u * (1D + {total.format(up, rise)} + {total.format(down, fall)}))")
    raised = walk.format(up, rise, "1D")
    lowered = walk.format(down, fall, "r.s")
    pick = (f"if(p.t <= 1D, p.mode, transform(array({raised}), r -> coalesce(r.k, ({lowered}).k, p.mode))[0])")
    return (f"transform(transform(transform(array({bounds}), b -> {mode}), p -> {scaled}), p -> {pick})[0]")


def shard_quotas(copies: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """_key, _shares: how many of the source's block copies each shard gets, in shard order.

    copies: _key, n_copies, one row per source. ``shards`` is a power of two. The table of sources is
    taken as bounded: a node of the tree is one row with an array over sources.
    """
    quota = F.sort_array(F.collect_list(F.struct("_key", F.col("n_copies").cast("long").alias("q"))))
    nodes = copies.agg(quota.alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    size = 1
    while size < shards:
        uniform = f"pmod(xxhash64({seed}L, {size}L, node, x._key), 1048576L * 4096L) / (1048576D * 4096D)"
        drawn = _hypergeometric(uniform, "acc.pool", "x.q", "acc.need")
        split = nodes.withColumn("total", F.expr("aggregate(quotas, 0L, (a, x) -> a + x.q)")).withColumn("lefts", F.expr(
            "aggregate(quotas, named_struct('pool', total, 'need', total div 2, 'out', CAST(array() AS array<bigint>)), "
            f"(acc, x) -> transform(array({drawn}), k -> named_struct('pool', acc.pool - x.q, 'need', acc.need - k, "
            "'out', concat(acc.out, array(k))))[0], acc -> acc.out)"))
        left = "transform(quotas, (x, i) -> named_struct('_key', x._key, 'q', lefts[i]))"
        right = "transform(quotas, (x, i) -> named_struct('_key', x._key, 'q', x.q - lefts[i]))"
        nodes = split.select(F.expr(f"inline(array(struct(2 * node AS node, {left} AS quotas), "
                                    f"struct(2 * node + 1 AS node, {right} AS quotas)))"))
        size *= 2
    each = nodes.select("node", F.inline("quotas"))
    shares = F.transform(F.sort_array(F.collect_list(F.struct("node", "q"))), lambda x: x["q"])
    return each.groupBy("_key").agg(shares.alias("_shares"))


def block_plan(sizes: DataFrame, targets: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """_key, _block, and _copies: for each copy of the block its pass, its shard, and the words it may use.

    ``room`` is null where the whole block is taken.
    """
    blocks = sizes.groupBy("_key", "_block").agg(F.sum("_size").alias("_words")).where("_words > 0")
    blocks = blocks.withColumn("_before", F.sum("_words").over(W.partitionBy("_key").orderBy("_block")) - F.col("_words"))
    blocks = blocks.join(targets.select("_key", "_passes", "_rest"), "_key")
    passes = F.when(F.col("_before") < F.col("_rest"), F.col("_passes") + 1).otherwise(F.col("_passes"))
    room = F.when(
        (F.col("pass") == F.col("_passes")) & (F.col("_before") + F.col("_words") > F.col("_rest")),
        F.col("_rest") - F.col("_before"),
    )
    copies = (blocks.withColumn("_n", passes).where("_n > 0")
              .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("room", room))
    shares = shard_quotas(copies.groupBy("_key").agg(F.count("*").alias("n_copies")), shards, seed)
    turn = F.row_number().over(W.partitionBy("_key").orderBy(F.xxhash64(F.lit(seed), "_key", "_block", "pass"), "_block", "pass"))
    ends = F.expr("transform(_shares, (x, i) -> aggregate(slice(_shares, 1, i + 1), 0L, (a, y) -> a + y))")
    dealt = copies.withColumn("_turn", turn).join(shares.withColumn("_ends", ends), "_key")
    dealt = dealt.withColumn("shard", F.expr("size(filter(_ends, e -> e < _turn))"))
    return dealt.groupBy("_key", "_block").agg(F.collect_list(F.struct("pass", "shard", "room")).alias("_copies"))


def plan(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The targets by source and the plan by block, both settled. Runs jobs; reads the texts once."""
    sizes = settled(sized(docs, seed).groupBy("_key", "_block").agg(F.sum("_size").alias("_size")))
    targets = settled(source_targets(sizes))
    blocks = settled(block_plan(sizes, targets, shards, seed))
    # Without its own shuffle by block if the plan is small; any larger plan is joined as Spark sees fit.
    return targets, F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks


def draw(docs: DataFrame, blocks: DataFrame, *, seed: int = SEED, undrawn: bool = False) -> DataFrame:
    """A row for each copy of a document in the mix: all columns, _size, _key, and pass, shard, words, order_key.

    The document where a source's quota ends gives only its first ``words`` words; all others are whole.
    With ``undrawn``, documents the mix leaves out have one row with words 0. Rows of a shard are read in
    the order of order_key.
    """
    rows = sized(docs, seed)
    drawn = rows.join(blocks, ["_key", "_block"], "left").withColumn("_copy", F.explode_outer("_copies"))
    whole = drawn.where(F.col("_copy.room").isNull()).withColumn("words", F.when(F.col("_copy").isNull(), 0).otherwise(F.col("_size")))
    # At most one block of a source is taken in part: its documents in hash order, until the room is used up.
    part = drawn.where(F.col("_copy.room").isNotNull())
    used = F.sum("_size").over(W.partitionBy("_key").orderBy("_order", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1))
    room = F.col("_copy.room") - F.coalesce(used, F.lit(0))
    part = part.withColumn("words", F.least(F.col("_size"), F.greatest(room, F.lit(0))))
    out = whole.unionByName(part)
    if not undrawn:
        out = out.where((F.col("words") > 0) | (F.col("_size") == 0) & F.col("_copy").isNotNull())
    return out.select(
        *[rows[c] for c in rows.columns if c not in ("_order", "_block")],
        F.col("_copy.pass").alias("pass"), F.col("_copy.shard").alias("shard"), F.col("words").cast("long").alias("words"),
        F.xxhash64(F.lit(seed), F.col("_copy.shard"), "_order", F.col("_copy.pass")).alias("order_key"),
    )


def taken(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For each row of documents: doc_id, size, source_size, target (its source's), taken (words in the mix).

    Null or empty texts have size 0 and are never taken; a null source is a source of its own; a null
    doc_id is read as an empty name. Repeated rows are each documents of their own. If no document has a
    word, all targets are 0; an empty table gives an empty result. Runs jobs when called.
    """
    own = documents(docs, "doc_id", "text", "source").withColumn("_row", F.monotonically_increasing_id())
    targets, blocks = plan(own, shards=shards, seed=seed)
    rows = draw(own, blocks, seed=seed, undrawn=True).groupBy("_row", "doc_id", "_key", "_size").agg(F.sum("words").alias("taken"))
    return rows.join(targets, "_key", "left").select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def slots(spark: SparkSession, n: int) -> Column:
    """An array of ``n`` numbers, one that ``repartition(n, number)`` sends to each of its partitions."""
    tried = n * (math.ceil(math.log(n + 1)) + 8)
    while True:
        found = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("number")).collect()
        if len(found) == n:
            return F.lit([number for _, number in sorted(found)]).cast("array<bigint>")
        tried *= 2


def mix(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The mixed rows of documents, all columns, one row for each time a document is drawn.

    Texts stay whole: where a source's quota ends inside a document, it is drawn if at least half of it
    is wanted. A shard is cut by ranges of its rows' hashes into pieces of some ``piece_words`` words; each is one
    partition, in the order of the hashes. Very long texts are drawn whole. Cases as in ``taken``; extra columns
    of any name are kept. An empty table gives an empty result.
    """
    own = documents(docs, "doc_id", "text", "source", whole=True)
    targets, blocks = plan(own, shards=shards, seed=seed)
    words = targets.agg(F.sum(F.col("_passes") * F.col("source_size") + F.col("_rest"))).first()[0] or 0
    pieces = max(1, math.ceil(words / shards / piece_words))
    rows = draw(own, blocks, seed=seed).where(2 * F.col("words") >= F.col("_size"))
    piece = F.least(F.lit(pieces - 1), F.floor((F.col("order_key") / F.lit(2.0**64) + 0.5) * pieces).cast("int"))
    place = slots(docs.sparkSession, shards * pieces)[F.col("shard") * pieces + piece]
    placed = rows.withColumn("_place", place).repartition(shards * pieces, "_place")
    return placed.sortWithinPartitions("shard", "order_key").select("_whole.*")


#: The same figures from windows over all documents.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest
  FROM targets
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sized
)
SELECT p.doc_id, p.size, q.source_size, q.target,
       CAST(q.passes * p.size + greatest(0, least(p.size, q.rest - p.before)) AS BIGINT) AS taken
FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
"""
