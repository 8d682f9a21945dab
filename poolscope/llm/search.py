"""Exact BM25 top-k search: indexes by shard of like documents, bounds by block, merged with global statistics.

Each task inverts its documents into shards of bounded size: documents of one kind (those whose commonest words are the
same, as in a language) and of like lengths, the longest first, as these give the scores that others must reach. Queries
are whole texts, weighed by the global document frequencies, and are sent round in blocks of bounded size to all shards.
Like queries form a side. A query leaves out a block of documents if all its terms, each at the largest contribution it
has there, stay below the k-th best score found in earlier blocks of the task. What is left is scored in single
precision: terms of many queries and documents are columns of a matrix, the others pairs of postings. What may be among
the k best by these scores, rounded up, is scored again exactly, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, release, words_on_workers
from poolscope.session import settled

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS = 1024
SHARD_POSTINGS = 1_000_000
GATHERED = 3_000_000
LEADS = 64
FEW = 16  # kinds of fewer texts than one in so many of a shard's or a side's are put together
BLOCK = 1024
HEAD_TERMS = 1536
MARGIN = 1.001e-6  # scores that round to the same 6 places differ by less
SIDE = 1024
QUERY_POSTINGS = 4_000_000
EXPANDED = 131_072
CROWDED = 0.003  # of all pairs of a query and a document: from here on a matrix product costs less than pairs of postings
BATCH_BYTES = 4_000_000
NO_HEAD = np.zeros(0, np.uint64)
WIDTHS = np.unique(np.r_[1:5, [x << i for i in range(1, 30) for x in (3, 4)]])
TABLES = np.searchsorted(WIDTHS, np.arange(2049)).astype(np.uint8)


def term_frequencies(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its words with A-Z in lower case, as 64-bit hashes, and how often each occurs; 12 bytes a posting.

    Words are bytes between ASCII whitespace, split and numbered by Arrow; each distinct one is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner, every = pc.list_parent_indices(split), pc.list_flatten(split)
    there = pc.greater(pc.binary_length(every), 0)
    coded = pc.dictionary_encode(every.filter(there))
    hashes = hash_array(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)
    key = owner.filter(there).to_numpy().astype(np.int64) * max(1, len(hashes)) + coded.indices.to_numpy()
    key, times = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key, np.arange(1, len(texts)) * max(1, len(hashes)))
    return list(zip(np.split(hashes[key % max(1, len(hashes))], cuts), np.split(times.astype(np.int32), cuts), strict=True))


def compact(own: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Terms and frequencies as arrays."""
    return np.fromiter(own.keys(), np.uint64, len(own)), np.fromiter(own.values(), np.int32, len(own))


@dataclass
class Shard:
    """terms ascending; documents and frequencies of term i at start[i] : start[i + 1]."""

    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    start: np.ndarray
    docs: np.ndarray
    times: np.ndarray

    @staticmethod
    def build(ids: list, own: list[Counter | tuple[np.ndarray, np.ndarray]]) -> Shard:
        own = [compact(c) if isinstance(c, Counter) else c for c in own]
        sizes = np.array([len(terms) for terms, _ in own], np.int64)
        lengths = np.array([times.sum() for _, times in own], np.int64)
        terms, times = (np.concatenate([x[at] for x in own]) for at in (0, 1))
        docs = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        by_term = np.argsort(terms, kind="stable")
        terms = terms[by_term]
        start = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        return Shard(np.array([-(1 << 63) if i is None else i for i in ids], np.int64), lengths, terms[start],
                     np.append(start, len(terms)).astype(np.int64), docs[by_term], times[by_term])

    _fields = ("ids", "lengths", "terms", "start", "docs", "times")
    _kinds = (np.int64, np.int64, np.uint64, np.int64, np.int32, np.int32)

    def packed(self) -> list[bytes]:
        return [getattr(self, f).astype(k).tobytes() for f, k in zip(self._fields, self._kinds, strict=True)]

    @staticmethod
    def unpacked(batch: pa.RecordBatch) -> Iterator[Shard]:
        """The shards of a batch, one at a time, as views of its memory."""
        for i in range(batch.num_rows):
            yield Shard(*[np.frombuffer(batch.column(f)[i].as_buffer(), k) for f, k in zip(Shard._fields, Shard._kinds, strict=True)])

    def contributions(self, mean_length: float, k1: float = K1, b: float = B) -> np.ndarray:
        """What each posting adds to a score for a weight of 1."""
        norm = k1 * (1 - b + b * self.lengths / max(mean_length, 1e-9))
        return self.times * (k1 + 1) / (self.times + norm[self.docs])

    def laid(self, weight: np.ndarray) -> Laid:
        """Laid out for these contributions of its postings; kept for the next side."""
        if getattr(self, "_laid", None) is None or self._laid.weight is not weight:
            self._laid = Laid.out(self, weight)
        return self._laid

    def pieces(self, wanted: np.ndarray | Places, most: int) -> Iterator[Shard]:
        """The shard cut into runs of at most ``most`` documents, terms as their places among the wanted ones, without the others."""
        number = wanted.of(self.terms) if isinstance(wanted, Places) else _places(wanted, self.terms)
        length = np.diff(self.start)
        kept = np.repeat(number >= 0, length)
        docs, times = self.docs[kept], self.times[kept]
        length, number = length[number >= 0], number[number >= 0]
        if len(self.ids) <= most:
            yield Shard(self.ids, self.lengths, number, np.append(0, np.cumsum(length)), docs, times)
            return
        order = np.argsort(docs // most, kind="stable")
        number, docs, times = np.repeat(number, length)[order], docs[order], times[order]
        cuts = np.searchsorted(docs // most, np.arange(-(-len(self.ids) // most) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            first = np.flatnonzero(np.diff(number[a:b], prepend=-1))
            rows = slice(i * most, (i + 1) * most)
            yield Shard(self.ids[rows], self.lengths[rows], number[a:b][first], np.append(first, b - a), docs[a:b] - i * most, times[a:b])


class Places:
    """Where terms are among ascending ones, by the first bits of their hashes: a table leads next to the place."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.shift = np.uint64(64 - max(1, int(len(terms)).bit_length()))
        self.first = np.searchsorted(terms, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The places of the wanted ones; -1 if they aren't there."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        last = len(self.terms) - 1
        at = np.minimum(self.first[(wanted >> self.shift).astype(np.int64)], last).astype(np.int64)
        found = self.terms[at]
        further = np.flatnonzero((found < wanted) & (at < last))
        for _ in range(16):
            if not len(further):
                break
            at[further] += 1
            found[further] = self.terms[at[further]]
            further = further[(found[further] < wanted[further]) & (at[further] < last)]
        if len(further):  # terms that aren't spread like hashes
            return _places(self.terms, wanted)
        return np.where(found == wanted, at, -1)


def kinds(own: list[tuple[np.ndarray, np.ndarray]], few: int) -> np.ndarray:
    """A number for each text, given as terms and how often they occur; texts whose commonest words are the same share it.

    The words that lead the most texts are put together where half of the texts that hold one hold the other too, as
    those of a language are. Texts of two such languages are apart from the others, and together if fewer than ``few``
    are alike. It only decides what lies together, never what is found.
    """
    lead = np.array([terms[np.argmax(times)] if len(terms) else 0 for terms, times in own], np.uint64)
    leads, votes = np.unique(lead, return_counts=True)
    leads = np.sort(leads[np.argsort(-votes, kind="stable")[:LEADS]])
    there = np.zeros((len(own), len(leads)), np.float32)
    for i in range(0, len(own), 256):
        part = [terms for terms, _ in own[i : i + 256]]
        every = np.concatenate(part).view(np.uint64)
        at = np.minimum(np.searchsorted(leads, every), len(leads) - 1)
        hit = np.flatnonzero(leads[at] == every)
        there[np.repeat(np.arange(i, i + len(part)), [len(x) for x in part])[hit], at[hit]] = 1
    both, alone = there.T @ there, there.sum(0)
    near = (2 * both >= np.maximum(alone[:, None], alone)) | np.eye(len(leads), dtype=bool)
    label = np.arange(len(leads))
    for _ in leads:
        label = np.where(near, label, len(leads)).min(1)
    tells = there * np.log1p(len(own) / np.maximum(alone, 1))
    tells = np.stack([tells[:, label == x].sum(1) for x in np.unique(label)], 1)
    first = tells.argmax(1)
    rest = tells.copy()
    rest[np.arange(len(own)), first] = 0
    second = np.where(2 * rest.max(1) > tells.max(1), rest.argmax(1) + 1, 0)
    kind = first * (tells.shape[1] + 2) + second
    apart = np.where(second > 0, first * (tells.shape[1] + 2) + tells.shape[1] + 1, kind)
    kind = np.where(np.bincount(kind, minlength=1)[kind] < few, apart, kind)
    return np.where(np.bincount(kind, minlength=1)[kind] < few, -1, kind)


def gathered(ids: list, own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[Shard]:
    """Shards of like documents: of one kind and of like lengths, the longest first, as these give the scores to beat."""
    lengths = np.array([times.sum() for _, times in own], np.int64)
    kind = kinds(own, SHARD_DOCS // FEW)
    runs = []
    for each in np.unique(kind):
        order = np.flatnonzero(kind == each)
        order = order[np.argsort(-lengths[order], kind="stable")]
        cuts, postings = [0], 0
        for i, doc in enumerate(order.tolist()):
            more = len(own[doc][0])
            if i > cuts[-1] and (i - cuts[-1] == SHARD_DOCS or postings + more > SHARD_POSTINGS):
                cuts.append(i)
                postings = 0
            postings += more
        runs += [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]
    for run in sorted(runs, key=lambda x: -lengths[x].mean()):
        yield Shard.build([ids[i] for i in run], [own[i] for i in run])


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard, of at most SHARD_DOCS documents and, unless it is one document, SHARD_POSTINGS postings."""
    words_on_workers(docs.sparkSession)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        own: list[tuple[np.ndarray, np.ndarray]] = []
        postings = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for shard in gathered(ids, own):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.packed()], list(Shard._fields))

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), term_frequencies(batch.column("text")), strict=True):
                ids.append(doc_id)
                own.append(found)
                postings += len(found[0])
                if postings >= GATHERED:
                    yield from rows()
                    ids, own, postings = [], [], 0
        if ids:
            yield from rows()
        release()

    return documents(docs, "doc_id", "text").mapInArrow(invert, ", ".join(f"{f} binary" for f in Shard._fields))


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df over all shards."""

    def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        terms, df = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(terms[order]) != 0])
        terms, df = terms[order][first], np.add.reduceat(df[order], first)
        for i in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000]), pa.array(df[i : i + 100_000])], ["term", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                terms, start = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("terms", "start"))
                if len(terms):
                    found.append((terms.copy(), np.diff(start)))
                if sum(len(x) for x, _ in found) >= SHARD_POSTINGS:
                    yield from summed(found)
                    found = []
        if found:
            yield from summed(found)

    return index.select("terms", "start").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_vectors(queries: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """query_id, terms, weights: how often each term occurs in the query times its inverse document frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = term_frequencies(batch.column("text"))
            ids = np.repeat(batch.column("query_id").to_numpy(zero_copy_only=False), [len(terms) for terms, _ in found])
            terms = np.concatenate([x for x, _ in found]).astype(np.int64)
            times = np.concatenate([x for _, x in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms), pa.array(times)], ["query_id", "term", "times"])
        release()

    each = queries.select("query_id", "text").mapInArrow(count, "query_id long, term long, times long")
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = each.join(frequencies, "term").select("query_id", F.struct("term", (F.col("times") * idf).alias("weight")).alias("t"))
    lists = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... length[0] of them, then the same for the next."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


@dataclass
class Side:
    """Some queries: where the frequent terms lie in the matrix of their weights, and the weights of the others by term."""

    ids: np.ndarray
    cells: np.ndarray
    values: np.ndarray
    terms: np.ndarray
    start: np.ndarray
    queries: np.ndarray
    weights: np.ndarray

    @staticmethod
    def build(ids: list[int], terms: list[np.ndarray], weights: list[np.ndarray], head: np.ndarray) -> Side:
        every, w = np.concatenate(terms).astype(np.int64).view(np.uint64), np.concatenate(weights)
        owner = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        at = np.minimum(np.searchsorted(head, every), max(0, len(head) - 1))
        is_head = head[at] == every if len(head) else np.zeros(len(every), bool)
        cells, values = (owner * len(head) + at)[is_head].astype(np.int32), w[is_head]
        every, w, owner = every[~is_head], w[~is_head], owner[~is_head]
        order = np.argsort(every, kind="stable")
        distinct, start = np.unique(every[order], return_index=True)
        return Side(np.array(ids), cells, values, distinct, np.append(start, len(every)), owner[order].astype(np.int32), w[order])

    def matrix(self, width: int) -> np.ndarray:
        """Weights of the frequent terms by query. Made for each shard, as those of all queries of a block would fill a worker."""
        out = np.zeros(len(self.ids) * width)
        out[self.cells] = self.values
        return out.reshape(len(self.ids), width)


@dataclass
class Laid:
    """What all sides need of a piece: largest contributions by term, postings by document, and tables of terms of like length."""

    weight: np.ndarray
    most: np.ndarray
    table: np.ndarray
    row: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]
    by_doc: np.ndarray
    doc_terms: np.ndarray
    doc_weights: np.ndarray
    scratch: np.ndarray

    @staticmethod
    def out(piece: Shard, weight: np.ndarray) -> Laid:
        length = np.diff(piece.start)
        most = np.maximum.reduceat(weight, piece.start[:-1]) if len(length) else np.zeros(0)
        # A table has the documents of terms in rows of one width, the last one repeated with nothing to add.
        table = TABLES[np.minimum(length, len(TABLES) - 1)] if length.max(initial=0) < len(TABLES) else np.searchsorted(WIDTHS, length).astype(np.uint8)
        row = np.zeros(len(length), np.int64)
        tables: list = [None] * len(WIDTHS)
        docs, light = piece.docs, weight.astype(np.float32)
        for i in np.flatnonzero(np.bincount(table, minlength=len(WIDTHS))):
            own = np.flatnonzero(table == i)
            row[own] = np.arange(len(own))
            at = np.minimum(np.arange(WIDTHS[i], dtype=np.int32), (length[own, None] - 1).astype(np.int32))
            more = at < np.arange(WIDTHS[i], dtype=np.int32)
            at += piece.start[own, None].astype(np.int32)
            values = light.take(at)
            values[more] = 0
            tables[i] = docs.take(at).astype(np.int64), values
        order = np.argsort(piece.docs.astype(np.uint16) if len(piece.ids) <= 1 << 16 else piece.docs, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(piece.docs, minlength=len(piece.ids)))]
        return Laid(weight, most, table, row, tables, cuts, np.repeat(np.arange(len(length), dtype=np.int32), length)[order], weight[order], np.zeros(len(length)))


def _add_pairs(flat: np.ndarray, laid: Laid, place: np.ndarray, cell: np.ndarray, value: np.ndarray) -> None:
    """Adds to flat, from each cell on, the contributions of the term at each place; the places in order of their tables."""
    cuts = np.searchsorted(laid.table[place], np.arange(len(WIDTHS) + 1))
    cells, values = np.empty(EXPANDED, np.int64), np.empty(EXPANDED, np.float32)
    row = laid.row[place]
    for i in np.flatnonzero(np.diff(cuts)):
        docs, weights = laid.tables[i]
        width = docs.shape[1]
        # Buffers are used again, as memory that comes from the system at each step costs more than the sums.
        if width > len(cells):
            cells, values = np.empty(width, np.int64), np.empty(width, np.float32)
        step = len(cells) // width
        for j in range(cuts[i], cuts[i + 1], step):
            own = slice(j, min(j + step, cuts[i + 1]))
            m = own.stop - own.start
            at, v = cells[: m * width].reshape(m, width), values[: m * width].reshape(m, width)
            docs.take(row[own], axis=0, out=at, mode="clip")
            at += cell[own, None]
            weights.take(row[own], axis=0, out=v, mode="clip")
            v *= value[own, None]
            np.add.at(flat, at.ravel(), v.ravel())


def _exact(laid: Laid, place: np.ndarray, asker: np.ndarray, value: np.ndarray, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Scores in double precision of documents for queries, these ascending."""
    out = np.zeros(len(query))
    asked = np.zeros(asker.max(initial=0) + 1, bool)
    asked[query] = True
    own = np.flatnonzero(asked[asker])
    own = own[np.argsort(asker[own].astype(np.uint16), kind="stable")]
    place, value, cuts = place[own], value[own], np.r_[0, np.cumsum(np.bincount(asker[own]))].tolist()
    order = np.argsort(doc, kind="stable")
    last, scratch = -1, laid.scratch
    for at, q, d in zip(order.tolist(), query[order].tolist(), doc[order].tolist(), strict=True):
        if d != last:
            if last >= 0:
                scratch[terms] = 0
            last, terms = d, laid.doc_terms[laid.by_doc[d] : laid.by_doc[d + 1]]
            scratch[terms] = laid.doc_weights[laid.by_doc[d] : laid.by_doc[d + 1]]
        out[at] = scratch[place[cuts[q] : cuts[q + 1]]] @ value[cuts[q] : cuts[q + 1]]
    if last >= 0:
        scratch[terms] = 0
    return out


def _match(side: Side, piece: Shard, at: np.ndarray, weight: np.ndarray, head: np.ndarray, k: int,
           floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, documents and exact scores of what may be among the k best of the side's queries.

    at: the places of the terms of head and then of the side's others in the piece, -1 if they aren't there.
    """
    n, nq, least = len(piece.ids), len(side.ids), floor - MARGIN
    laid = piece.laid(weight)
    term = np.flatnonzero(at[len(head) :] >= 0)
    place, first = at[len(head) :][term], side.start[term]
    many = side.start[term + 1] - first
    posting = _ranges(first, many)
    # Unpickled arrays hold a dtype of their own, with which numpy takes far longer; hence the view.
    place, asker, value = np.repeat(place, many), side.queries.take(posting), side.weights.view(np.float64).take(posting)
    if len(side.cells):
        cell, column = np.divmod(side.cells, np.int32(len(head)))
        there = at[column] >= 0
        place, asker, value = np.r_[at[column][there], place], np.r_[cell[there], asker], np.r_[side.values[there], value]
    # What a query could reach if one document had each term at its most: hardly anything where the languages differ.
    reach = np.bincount(asker, value * laid.most.take(place), nq)
    alive = (reach * (1 + 1e-9) >= least) & (reach > 0)
    rows = np.flatnonzero(alive)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(rows) < nq:
        own = np.flatnonzero(alive.take(asker))
        place, asker, value = place.take(own), (np.cumsum(alive) - 1).take(asker.take(own)), value.take(own)
    asker = asker.astype(np.int64)
    # A term of many queries and documents costs less as a column of a matrix than as pairs of postings.
    pairs = np.bincount(place, minlength=len(laid.most)) * np.diff(piece.start)
    crowded = np.flatnonzero(pairs > CROWDED * len(rows) * n)
    if len(crowded) > HEAD_TERMS:
        crowded = crowded[np.argsort(-pairs[crowded], kind="stable")[:HEAD_TERMS]]
    column = np.full(len(laid.most), -1)
    column[crowded] = np.arange(len(crowded))
    of = column[place]
    dense = of >= 0
    asked = np.zeros((len(rows), len(crowded)), np.float32)
    asked.ravel()[asker[dense] * len(crowded) + of[dense]] = value[dense]
    length = piece.start[crowded + 1] - piece.start[crowded]
    here = _ranges(piece.start[crowded], length)
    columns = np.zeros((len(crowded), n), np.float32)
    columns.ravel()[np.repeat(np.arange(len(crowded)) * n, length) + piece.docs[here]] = weight[here]
    upper = asked @ columns
    rare = np.flatnonzero(~dense)
    rare = rare[np.argsort(laid.table[place[rare]], kind="stable")]
    _add_pairs(upper.ravel(), laid, place[rare], asker[rare] * n, value[rare].astype(np.float32))
    # Sums in single precision, of nothing below 0, are off by less than this share of themselves.
    off = 1 + (np.bincount(asker).max() + 8) * 2.0**-23
    least = least[rows]
    found = np.flatnonzero(upper >= np.maximum(least / off, np.finfo(np.float32).tiny).astype(np.float32)[:, None] * np.float32(1 - 2**-22))
    many = np.flatnonzero(np.bincount(found // n, minlength=len(rows)) > 2 * k)
    if len(many) and n >= k:
        # While few documents are known: only what the k-th largest, less what it may be off, doesn't rule out.
        kth = np.partition(upper[many], -k, axis=1)[:, -k].astype(np.float64)
        least[many] = np.maximum(least[many], kth / off - MARGIN)
        found = found[upper.ravel()[found] >= (least / off * (1 - 2.0**-22))[found // n]]
    query, doc = np.divmod(found, n)
    exact = _exact(laid, place, asker, value, query, doc)
    real = exact > 0
    return rows[query[real]], piece.ids[doc[real]], exact[real]


def search_shard(side: Side, shard: Shard, head: np.ndarray, mean_length: float, k: int, floor: np.ndarray,
                 k1: float = K1, b: float = B) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the documents of the shard that may be among its k best, with exact scores.

    floor: a score per query that k documents elsewhere reach; -1 if there are none.
    """
    query, ids, scores = _match(side, shard, _places(shard.terms, np.r_[head, side.terms]), shard.contributions(mean_length, k1, b), head, k, floor)
    order = np.argsort(query, kind="stable")
    cuts = np.searchsorted(query[order], np.arange(1, len(side.ids)))
    return list(zip(np.split(ids[order], cuts), np.split(scores[order], cuts), strict=True))


def _places(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted ones are in the ascending terms; -1 if they aren't there."""
    at = np.searchsorted(terms, wanted)
    there = at < len(terms)
    there[there] = terms[at[there]] == wanted[there]
    return np.where(there, at, -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.round(scores, 6)))[:k]
    return ids[order], scores[order]


class Best:
    """The k best documents so far of some queries, and the scores that others must reach."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -1.0)
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges only once there is about one for each query: a merge sorts them all."""
        if len(query):
            self._new.append((query, ids, scores))
        if sum(len(x[0]) for x in self._new) >= len(self.floor):
            self.merge()

    def merge(self) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip((self.query, self.ids, self.scores), *self._new, strict=True))
        self._new = []
        order = np.lexsort((ids, -np.round(scores, 6), query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < self.k]
        self.query, self.ids, self.scores = query[order], ids[order], scores[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.floor)) == self.k)
        least = np.full(len(self.floor), np.inf)
        np.minimum.at(least, self.query, self.scores)
        self.floor[full] = least[full]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column, as arrays."""
    column = column.combine_chunks()
    return np.split(column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())[:-1])


def _once(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending terms, each once with the sum of its weights: rows that share a query_id repeat terms."""
    if (terms[1:] != terms[:-1]).all():
        return terms, weights
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    return terms[first], np.add.reduceat(weights, first)


def sides_of(ids: list[int], terms: list[np.ndarray], weights: list[np.ndarray]) -> list[Side]:
    """The queries in sides of like ones, by kind and by length."""
    terms, weights = zip(*map(_once, terms, weights), strict=True)
    kind = kinds(list(zip(terms, weights, strict=True)), SIDE // FEW)
    order = sorted(range(len(ids)), key=lambda i: (kind[i], len(terms[i]), ids[i]))
    sides = (order[i : i + SIDE] for i in range(0, len(order), SIDE))
    return [Side.build([ids[i] for i in own], [terms[i] for i in own], [weights[i] for i in own], NO_HEAD) for own in sides]


def search(docs: DataFrame, queries: DataFrame, *, k: int = TOP, query_postings: int = QUERY_POSTINGS) -> DataFrame:
    """query_id, rank, doc_id, score: the k rows of docs with the highest BM25 scores above 0 for each query.

    docs: doc_id, text. queries: query_id, text; whole texts, whose repeated words count as often. Scores are rounded to
    6 places, ties go to the smaller doc_id. A query that shares no word with any document, or has a null or
    empty text, has no rows; null or empty documents are never found. Repeated rows of docs are found each;
    queries that share a query_id are one query of all their words. A null doc_id comes before all others; queries with a null id are left out. Runs jobs when
    called: one over the texts, and one over the index for each block of some ``query_postings`` query terms.
    """
    spark = docs.sparkSession
    words_on_workers(spark)
    index = settled(build_index(docs))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x, np.int64) for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], ["n", "total"])

    whole = index.select("lengths").mapInArrow(sizes, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_docs = whole["n"] or 0
    mean_length = (whole["total"] or 0) / max(1, n_docs)
    asked = queries.select(queries["query_id"].cast("long").alias("query_id"), queries["text"].cast("string").alias("text"))
    asked = asked.where(F.col("query_id").isNotNull())
    vectors = settled(query_vectors(asked, document_frequencies(index), n_docs))
    postings = vectors.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(postings / query_postings))
    vectors = vectors.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    tasks = spark.sparkContext.defaultParallelism
    kind = "query_id long, doc_id long, score double"
    parts = []
    for block in range(blocks):
        rows = vectors.where(F.col("block") == block).orderBy("query_id").toArrow()
        if not rows.num_rows:
            continue
        terms, weights = (_lists(rows.column(c)) for c in ("terms", "weights"))
        shared = spark.sparkContext.broadcast(sides_of(rows.column("query_id").to_pylist(), terms, weights))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sides = shared.value
            wanted = np.unique(np.concatenate([side.terms for side in sides]))
            numbers = [np.searchsorted(wanted, side.terms) for side in sides]
            places = Places(wanted)
            best = [Best(len(side.ids), k) for side in sides]
            place = np.full(len(wanted), -1)
            for batch in batches:
                for shard in Shard.unpacked(batch):
                    for piece in shard.pieces(places, BLOCK):
                        weight = piece.contributions(mean_length)
                        place[piece.terms] = np.arange(len(piece.terms))
                        for side, number, own in zip(sides, numbers, best, strict=True):
                            own.add(*_match(side, piece, place[number], weight, NO_HEAD, k, own.floor))
                        place[piece.terms] = -1
            for side, own in zip(sides, best, strict=True):
                own.merge()
                if len(own.ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(side.ids[own.query], pa.int64()), pa.array(own.ids, pa.int64()), pa.array(own.scores, pa.float64())],
                        ["query_id", "doc_id", "score"])
            release()

        parts.append(settled(index.coalesce(tasks).mapInArrow(find, kind)))
        shared.unpersist()
    every = parts[0] if parts else spark.createDataFrame([], kind)
    for part in parts[1:]:
        every = every.unionByName(part)
    rounded = every.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best = rounded.withColumn("rank", rank).where(F.col("rank") <= k)
    doc_id = F.when(F.col("doc_id") == -(1 << 63), F.lit(None).cast("long")).otherwise(F.col("doc_id"))
    return best.select("query_id", "rank", doc_id.alias("doc_id"), "score")
