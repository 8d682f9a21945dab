"""Alignment of two tokenizers' tokens on the bytes of each text.

A batch of texts is encoded by both sides; tokens become byte ranges. ``pandas.merge_asof``, keyed by offsets that
run on from document to document, finds for each token start the other side's token that covers it. Two ranges overlap exactly if
one's start lies in the other, so both directions together are all overlaps. Where both sides start
(end) at one byte a group starts (ends).

How often an id pair is linked is counted over the whole corpus. Each document keeps its distinct pairs
with their numbers; the counts of the most frequent pairs, a bounded number, are sent to all tasks, and
the documents' other pairs meet theirs in a join.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, words_on_workers
from poolscope.session import settled

BATCH_BYTES = 2_000_000
CACHED_PARTS = 200_000
CACHED_CHARS = 48
FREQUENT = 1 << 20
#: A pair of ids is one number: A's id, then 15 bits for B's.
SHIFT = 15

# White space as Unicode has it, and the letters that stand for bytes in a byte-level vocabulary.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


class Side:
    """One tokenizer: parts of a text that are encoded alone as within it, their ids, and each id's bytes."""

    def __init__(self, pattern: str, tokens: list[bytes]):
        self.parts = re.compile(pattern).findall
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size)
        return self.all_bytes[shift + np.arange(len(shift))].tobytes()

    def encode(self, parts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None if their bytes aren't the text's."""
        cut = [self.parts(text) for text in texts]
        known = self.known
        missing = [p for p in set(chain.from_iterable(cut)) if p not in known]
        for part, ids in zip(missing, self.encode(missing), strict=True):
            known[part] = array("i", ids).tobytes()
        found = [np.frombuffer(b"".join(map(known.__getitem__, own)), np.int32) for own in cut]
        out: list[np.ndarray | None] = list(found)
        if self.bytes_of(np.concatenate([*found, np.zeros(0, np.int32)])) != "".join(texts).encode():
            out = [ids if self.bytes_of(ids) == text.encode() else None for ids, text in zip(found, texts, strict=True)]
        room = len(known) <= CACHED_PARTS
        for part in missing:
            if not room or len(part) > CACHED_CHARS:
                del known[part]
        return out


class ByteLevel(Side):
    """A byte-level tokenizers .json without prefix space; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        entries = [self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size())]
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        tokens = [e.encode() if e in special else bytes(_BYTE_OF[c] for c in e) for e in entries]
        # The pre-tokenizer never joins what this separates: the last blank of a run goes with the word after it.
        super().__init__(f" ?[^{_WS}]+|[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}](?=[^{_WS}])|[{_WS}]+", tokens)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(parts, add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece .model that puts a space before a text; every part starts with a space or U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        tokens = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]
        # No piece has a space after another letter, so no merge crosses a part's start.
        apart = not any(re.search("[^▁]▁", n) for n in names)
        super().__init__("[ ▁]*[^ ▁]+|[ ▁]+" if apart else "(?s).+", tokens)
        self.blank = self.model.piece_to_id("▁")

    def encode(self, parts: list[str]) -> list[list[int]]:
        # The model puts each part's first space back; to an empty rest it would not.
        found = self.model.encode([p[1:] for p in parts], num_threads=1)
        return [ids or [self.blank] for ids in found]


def covering(starts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each token start, the position of the other side's token that covers it.

    Offsets run on through a batch, so they are the key of the document too: both sides of a document start at the same one.
    """
    left = pd.DataFrame({"start": starts})
    right = pd.DataFrame({"start": other, "token": np.arange(len(other))})
    return pd.merge_asof(left, right, on="start")["token"].to_numpy()


class Aligned:
    """The tokens of a batch of documents on both sides, their links and groups.

    ``a`` and ``b`` hold each document's ids; both sides of a document cover the same bytes.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = np.concatenate([*a, np.zeros(0, np.int32)]), np.concatenate([*b, np.zeros(0, np.int32)])
        self.doc_a = np.repeat(np.arange(len(a)), self.n_a)
        # Offsets run on through the batch, so they are sorted over all documents.
        size_a, size_b = a_lengths[self.a], b_lengths[self.b]
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        over_a, over_b = covering(start_a, start_b), covering(start_b, start_a)
        self.opens_a, self.opens_b = start_b[over_a] == start_a, start_a[over_b] == start_b
        # Common starts are found from both sides; they count once.
        self.link_a = np.concatenate([np.arange(len(self.a)), over_b[~self.opens_b]])
        self.link_b = np.concatenate([over_a, np.flatnonzero(~self.opens_b)])

    def groups(self) -> np.ndarray:
        """Number of groups of each document."""
        return np.bincount(self.doc_a[self.opens_a], minlength=len(self.n_a))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each document: the pairs, how often each is linked, and how many a document has."""
        keys = self.doc_a[self.link_a] << 31 | self.a[self.link_a].astype(np.int64) << SHIFT | self.b[self.link_b]
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(keys)))
        per_doc = np.bincount(keys[first] >> 31, minlength=len(self.n_a))
        return (keys[first] & 0x7FFFFFFF).astype(np.int32), times.astype(np.int32), per_doc

    def texts(self, words: list[str], size: int) -> Iterator[str]:
        """Each document's groups as text: ids of A, |, ids of B, groups apart by semicolons.

        ``words`` holds every id with each of the endings of :func:`_words`, ``size`` ids an ending.
        """
        group_a, group_b = np.cumsum(self.opens_a) - 1, np.cumsum(self.opens_b) - 1
        n = int(self.opens_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[group_b]
        last_a, last_b = np.append(self.opens_a[1:], True), np.append(self.opens_b[1:], True)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[place_a] = self.a + size * last_a
        ends = 2 * last_b.astype(np.int64)
        ends[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        codes[place_b] = self.b + size * ends
        at = 0
        for length in (self.n_a + self.n_b).tolist():
            yield "".join(map(words.__getitem__, codes[at : at + length].tolist()))
            at += length


def _words(size: int) -> list[str]:
    return [f"{i}{end}" for end in (",", "|", ";", "") for i in range(size)]


def _documents(a: Side, b: Side, words: list[str], size: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    spaced = [" " + t for t in texts]
    none = np.zeros(0, np.int32)
    both = [
        (x, y) if t and x is not None and y is not None else (none, none)
        for t, x, y in zip(texts, a.ids(spaced), b.ids(spaced), strict=True)
    ]
    found = Aligned([x for x, _ in both], [y for _, y in both], a.lengths, b.lengths)
    pairs, times, per_doc = found.pairs()
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.texts(words, size)]
    links = np.bincount(found.doc_a[found.link_a], minlength=len(texts))
    bounds = pa.array(np.append(0, np.cumsum(per_doc)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (pairs, times)]
    numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.groups(), links)]
    names = [x.split()[0] for x in DOCUMENT.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(digests, pa.string()), *lists], names)


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pairs linked at least 2^k times, with the least k for which they are at most ``most``."""
    of_size = counts.groupBy(F.floor(F.log2(F.col("n"))).alias("k")).count().orderBy(F.desc("k")).collect()
    least, held = 64, 0
    for row in of_size:
        held += row["count"]
        if held > most:
            break
        least = row["k"]
    return counts.where(F.col("n") >= 2**least) if least < 63 else counts.limit(0)


def pair_counts(docs: DataFrame) -> DataFrame:
    """pair, n, best for each id pair linked in :func:`token_overlaps`' documents; best: no other pair of its B id has more."""
    counts = docs.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts = settled(counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)))
    # At most one row for each of 2^15 ids.
    top = counts.groupBy("b").agg(F.max("n").alias("_top"))
    return counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def token_overlaps(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row a document with its distinct linked id pairs: the columns of ``DOCUMENT``.

    ``pairs`` are A's id times 2^15 plus B's, ``times`` how often each is linked in the document.
    """
    words_on_workers(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = ByteLevel(a), Pieces(b)
        size = max(len(s.tokens) for s in sides)
        if len(sides[0].tokens) > 1 << 16 or len(sides[1].tokens) > 1 << SHIFT:
            raise ValueError("a pair of ids must fit 31 bits")
        words = _words(size)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            yield _documents(*sides, words, size, batch)

    return documents(docs, "doc_id", "text").mapInArrow(align, DOCUMENT)


def align_tokens(docs: DataFrame, a: str, b: str, *, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of documents.

    ``a``: a byte-level tokenizers .json, ``b``: a sentencepiece .model that puts a space first; both encode
    space and text. Texts that are null or empty, or whose tokens' bytes aren't space and text on both sides
    (U+2581 in a text reads as a space), have no tokens: zeros, and '' for the hash. Repeated rows are aligned
    and counted each; a null doc_id stays null; other columns of docs are ignored, whatever their names. Texts
    of any length are aligned whole. The counts of at most ``frequent`` pairs are sent to all tasks. An empty
    table gives an empty result. Runs jobs when called.
    """
    spark = docs.sparkSession
    own = settled(token_overlaps(docs, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = settled(pair_counts(own))
    table = _frequent(counts, frequent).orderBy("pair").toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    held = spark.sparkContext.broadcast((pair, n, best.astype(bool)))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, top = held.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            codes, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            per_doc = np.diff(pairs.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), per_doc)
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            here = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            at, times_here, doc_here = at[here], often[here], doc[here]
            sums, hits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, doc_here, number[at] * times_here)
            np.add.at(hits, doc_here, top[at] * times_here)
            rest = pa.array(np.append(0, np.cumsum(np.bincount(doc[~here], minlength=batch.num_rows))), pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(x)) for x in (codes[~here], often[~here].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(hits), pa.array(sums), *lists], [*kept, "hits", "sums", "pairs", "times"]
            )

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long"
    known = settled(own.mapInArrow(add_up, f"{kinds}, hits long, sums long, pairs array<int>, times array<int>"))
    rare = known.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    more = rare.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("_sums"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_hits")
    )
    out = known.join(more, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("hits") + F.coalesce("_hits", zero)).alias("n_best"), (F.col("sums") + F.coalesce("_sums", zero)).alias("count_sum"),
        "groups_sha256",
    )
