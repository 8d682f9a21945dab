"""Jaccard self-join of word shingles by chosen paths, as classes of near copies with numbers of links.

A run of the chosen-path recursion splits every set on tokens sampled by a hash of the path so far: a
token of the set is followed if its hash is below a threshold that makes one token shared with any
similar set survive a level on average. Two similar sets keep a common path through all levels of a run
with a known probability, so the number of runs follows from the target recall. Paths are a function of
the set alone, so the recursion needs no shuffle; sets that share a path meet in its bucket, where pairs
are verified exactly. Buckets with the same members are one bucket. Sets that share large buckets form
groups, dealt out in tiles of two chunks of bounded size, so no bucket is dropped or cut. Pairs never
leave a tile: it returns each set's number of links and the components that its links form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, release, words_on_workers
from poolscope.session import settled

SHINGLE = 5
LEAST = 0.8
RECALL = 0.999
SPREAD = 64
CHUNK = 256
SLAB = 4096
CELLS = 2_000_000
BATCH_BYTES = 4_000_000
HELD_WORDS = 300_000
BROADCAST_ROWS = 500_000

_held: dict[str, int] = {}
_U = np.uint64
_STEPS = [_U(int(x) | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled, one to one."""
    x = (x ^ (x >> _U(32))) * _STEPS[3]
    x = (x ^ (x >> _U(29))) * _STEPS[4]
    return x ^ (x >> _U(32))


def runs_for(recall: float, depth: int) -> int:
    """Runs after which two similar sets have met with probability ``recall``.

    At each level they follow at least one shared token on average; the number is binomial, and the
    chance of none is largest in the Poisson limit.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet)) if meet < 1 else 1


def depth_for(rows: int) -> int:
    """Levels so that paths spread over about as many buckets as there are rows, SPREAD a level; at least 3."""
    return max(3, math.ceil(math.log(max(rows, 1)) / math.log(SPREAD)))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words, ascending; of all words if there are fewer."""
    own = (text or "").encode().split()  # bytes split at ASCII white space only
    if not own:
        return np.zeros(0, _U)
    if len(_held) > HELD_WORDS:
        _held.clear()
    new = set(own).difference(_held)
    _held.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
    h = np.fromiter(map(_held.__getitem__, own), _U, len(own))
    width = min(size, len(own))
    out = np.full(len(own) - width + 1, _U(width))
    for i in range(width):
        out *= _STEPS[0]
        out += h[i : len(own) - width + 1 + i]
    return np.unique(mixed(out))


def chosen_paths(tokens: np.ndarray, runs: int, depth: int, least: float = LEAST) -> np.ndarray:
    """The set's paths after ``depth`` levels, of all runs."""
    n = len(tokens)
    if not n:
        return np.zeros(0, _U)
    path = mixed(np.arange(1, runs + 1, dtype=_U) * _STEPS[0])
    share = 1 / (least * n)
    bound = _U(min(int(share * 2.0**64), 2**64 - 1))
    rows = max(1, CELLS // n)
    for _ in range(depth):
        step = mixed(path) | _U(1)
        found = []
        for i in range(0, len(path), rows):
            cell = np.flatnonzero(np.multiply.outer(step[i : i + rows], tokens) <= bound)
            at = cell // n
            found.append(mixed(path[i + at] * _STEPS[1] + tokens[cell - at * n]))
        path = np.concatenate(found) if found else path
    return np.unique(path)


def signatures(docs: DataFrame, size: int, runs: int, depth: int, least: float) -> DataFrame:
    """doc_id, text_hash, n_shingles, s1, s2 (a hash of the set) and paths of each row. Reads each text once."""
    words_on_workers(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            n, s1, s2, paths = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, size)
                n.append(len(tokens))
                s1.append(int(np.bitwise_xor.reduce(mixed(tokens)).astype(np.int64)) if len(tokens) else 0)
                s2.append(int(np.add.reduce(mixed(tokens * _STEPS[2])).astype(np.int64)) if len(tokens) else 0)
                paths.append(chosen_paths(tokens, runs, depth, least).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                 pa.array(s2, pa.int64()), pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "s1", "s2", "paths"])
        release(_held)

    own = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return own.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, paths array<long>")


def shared_paths(classes: DataFrame) -> DataFrame:
    """bucket, c, n_members: the classes of each bucket of at least two, one bucket for each set of members."""
    each = classes.select("c", F.explode("paths").alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("c")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("x2")]
    many = each.groupBy("bucket").agg(F.count("*").alias("n_members"), *marks).where("n_members > 1")
    one = many.groupBy("n_members", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    return each.join(one.select("bucket", "n_members"), "bucket")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of slabs of columns."""
    out = np.zeros((len(a), len(b)), np.float32)
    lengths = [len(x) for x in (*a, *b)]
    every = np.concatenate([*a, *b]) if sum(lengths) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    number, count = np.unique(every, return_inverse=True, return_counts=True)[1:]
    shared = count > 1
    column = (np.cumsum(shared) - 1)[number]
    row, column = row[shared[number]], column[shared[number]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), SLAB):
        i, j = np.searchsorted(column, [start, start + SLAB])
        slab = np.zeros((len(lengths), min(SLAB, int(shared.sum()) - start)), np.float32)
        slab[row[i:j], column[i:j] - start] = 1
        out += slab[: len(a)] @ slab[len(a) :].T
    return out


def verify_tile(bucket: int | None, sides: list[tuple], least: float) -> Iterator[tuple[int, int, int]]:
    """c, links, root of the sets that have a link in a tile: of one chunk, or between two.

    sides: c, size, group (-1: none), tokens and buckets of each set, c ascending. Without ``bucket`` the tile
    is of a group and all its links count. Else links within a group are left to it, and others count in the
    least of the buckets both sets are in.
    """
    (ca, sa, ga, ta, la), (cb, sb, gb, tb, lb) = sides[0], sides[-1]
    if len(sides) == 1 and len(ca) < 2:
        return
    common = _overlaps(ta, tb)
    union = np.array([len(x) for x in ta])[:, None] + np.array([len(x) for x in tb])[None, :] - common
    linked = common >= least * union - 1e-6
    if len(sides) == 1:
        linked &= ~np.eye(len(ca), dtype=bool)
    if bucket is not None:
        linked &= (ga[:, None] != gb[None, :]) | (ga < 0)[:, None]
    if not linked.any():
        return
    root_a, root_b, most = ca.copy(), cb.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(root_a, np.where(linked, root_b[None, :], most).min(1))
        new_b = np.minimum(root_b, np.where(linked, new_a[:, None], most).min(0))
        if (new_a == root_a).all() and (new_b == root_b).all():
            break
        root_a, root_b = new_a, new_b
    counted = linked
    if bucket is not None:
        counted = linked & (_overlaps([x[x < bucket] for x in la], [x[x < bucket] for x in lb]) == 0)
    yield from zip(ca[linked.any(1)].tolist(), (counted @ sb)[linked.any(1)].tolist(), root_a[linked.any(1)].tolist(), strict=True)
    if len(sides) > 1:
        yield from zip(cb[linked.any(0)].tolist(), (counted.T @ sa)[linked.any(0)].tolist(), root_b[linked.any(0)].tolist(), strict=True)


def verify(tiles: DataFrame, least: float) -> DataFrame:
    """c, links, root from the rows of all tiles: each tile's lie together in a partition, in order."""
    keys = ["big", "bucket", "ti", "tj"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple[int, int, int]] = []
        now = None

        def finish() -> None:
            sides = []
            for chunk in dict.fromkeys(now[2:]):
                own = [r for r in held if r[0] == chunk]
                sides.append((*[np.array([r[i] for r in own], np.int64) for i in (1, 2, 3)], [r[4] for r in own], [r[5] for r in own]))
            done.extend(verify_tile(None if now[0] else now[1], sides, least))
            held.clear()

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], ["c", "links", "root"])
            done.clear()
            return out

        for batch in batches:
            heads = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            plain = list(zip(*[batch.column(k).to_pylist() for k in ("chunk", "c", "size", "g")], strict=True))
            lists = []
            for name in ("tokens", "buckets"):
                column = batch.column(name)
                ends, values = column.offsets.to_numpy(), column.values.to_numpy()
                lists.append([values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)])
            for head, row, tokens, buckets in zip(heads, plain, *lists, strict=True):
                if head != now:
                    if held:
                        finish()
                    now = head
                held.append((*row, tokens, buckets))
            if len(done) > 10_000:
                yield table()
        if held:
            finish()
        if done:
            yield table()

    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys, "chunk", "c")
    return dealt.mapInArrow(check, "c long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least member of each node's component. edges: u, v. Runs a job a round, few for shallow components."""
    both = settled(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settled(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["v"] == near["u"]).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("_at"), F.col("label").alias("_to"))
        new = lower.join(jump, lower["label"] == jump["_at"]).select("v", "was", F.least("label", "_to").alias("label"))
        new = settled(new)
        if new.where("label <> was").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _name() -> Column:
    """What tells a row's text from others: ids before no id, then the text's hash, as texts can share an id."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def near_copies(
    docs: DataFrame, *, size: int = SHINGLE, least: float = LEAST, recall: float = RECALL, chunk: int = CHUNK,
) -> DataFrame:
    """doc_id, class_id, n_links of each row of documents.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``least``. n_links counts the other rows linked to it, copies included; class_id is the least doc_id of
    the component that the links form. A link is found with probability ``recall`` at least. Texts of fewer words are one shingle of
    all their words; null texts and texts without words are linked to nothing and are their own class.
    Repeated rows are copies of each other. A null doc_id takes part; class_id is null where a component has
    no other id. An empty table gives an empty result. Runs jobs when called.
    """
    return text_classes(docs, size=size, least=least, recall=recall, chunk=chunk).drop("text_hash", "stays")


def text_classes(
    docs: DataFrame, *, size: int = SHINGLE, least: float = LEAST, recall: float = RECALL, chunk: int = CHUNK,
) -> DataFrame:
    """``near_copies`` with text_hash, which tells apart texts that share an id, and stays: true for one text of a class.

    That is the one with the least doc_id (null last), then the least hash.
    """
    depth = depth_for(docs.count())
    runs = runs_for(recall, depth)
    rows = settled(signatures(docs, size, runs, depth, least))
    same = ["n_shingles", "s1", "s2"]
    grouped = rows.where("n_shingles > 0").groupBy(*same).agg(
        F.count("*").alias("size"), F.min("doc_id").alias("id"), F.min(_name()).alias("rep"), F.first("paths").alias("paths"))
    classes = settled(grouped.withColumn("c", F.monotonically_increasing_id()))
    members = settled(shared_paths(classes))

    # Classes that share a bucket of more than a chunk form groups, verified as a whole: near copies of one text
    # share many such buckets, and would else be looked at in each of them.
    big = members.where(F.col("n_members") > chunk)
    least_of = big.groupBy("bucket").agg(F.min("c").alias("v"))
    groups = components(big.join(least_of, "bucket").where(F.col("c") != F.col("v")).select(F.col("c").alias("u"), "v"))
    groups = settled(groups.select(F.col("v").alias("c"), F.col("label").alias("g")))
    small = members.where(F.col("n_members") <= chunk).join(groups, "c", "left").select("bucket", "c", F.coalesce("g", F.lit(-1)).alias("g"))
    inside = small.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo = hi AND lo >= 0")
    small = settled(small.join(inside.select("bucket"), "bucket", "left_anti"))

    # Sets are computed again for these classes, from one text of each.
    wanted = small.select("c").unionByName(groups.select("c")).distinct().join(classes, "c")
    wanted = settled(wanted.select("c", "size", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash")))
    few = wanted.count() <= BROADCAST_ROWS
    own = documents(docs, "doc_id", "text")
    texts = own.join(F.broadcast(wanted) if few else wanted, own["doc_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(own["text"]) == wanted["_hash"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            tokens = [shingles(t, size).astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("size"), pa.array(tokens, pa.list_(pa.int64()))], ["c", "size", "tokens"])
        release(_held)

    tokens = texts.select("c", "size", "text").mapInArrow(sets, "c long, size long, tokens array<long>").dropDuplicates(["c"])
    lists = small.groupBy("c").agg(F.collect_list("bucket").alias("buckets"))
    one = small.select(F.lit(False).alias("big"), "bucket", "c", "g", *[F.lit(0).alias(k) for k in ("chunk", "ti", "tj")])
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_n"))
    dealt = groups.join(sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    many = dealt.select(F.lit(True).alias("big"), F.col("g").alias("bucket"), "c", "g", "chunk",
                        F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"))
    placed = one.unionByName(many).join(lists, "c", "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<bigint>")))
    found = settled(verify(placed.join(tokens, "c"), least))

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    labels = components(found.where("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v")))
    placed = classes.join(labels, classes["c"] == labels["v"], "left").select("c", "id", "rep", "size", *same, F.coalesce("label", "c").alias("label"))
    placed = settled(placed.join(links, "c", "left").select("id", "rep", "size", "label", *same, F.coalesce("links", F.lit(0)).alias("links")))
    names = placed.groupBy("label").agg(F.min("id").alias("class_id"), F.min("rep").alias("first"))
    named = placed.join(names, "label").select(*same, "class_id", "first", (F.col("links") + F.col("size") - 1).alias("n_links"), F.lit(True).alias("_has"))
    return rows.join(named, same, "left").select(
        "doc_id", "text_hash", F.when(F.col("_has"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.col("first").isNull() | F.col("first").eqNullSafe(_name())).alias("stays"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of documents, all columns, with one text of each class, once.

    The text with the least doc_id stays (null last), then the least hash. A text that is no copy of another stays
    whatever its id is and whatever else has that id; of rows with the same doc_id and text one stays, so a text without words
    stays once for each id that has it. Very long texts are compared whole; other cases as in ``near_copies``.
    """
    found = settled(text_classes(docs, **how).groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")))
    few = settled(found.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"))
    marks = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    own = docs.select(F.struct("*").alias("_row"), docs["doc_id"].alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    alone = own.join(marks, same, "left_anti").select("_row.*")
    once = own.join(marks.where("stays"), same, "left_semi").dropDuplicates(["_doc", "_text"]).select("_row.*")
    return alone.unionByName(once)
