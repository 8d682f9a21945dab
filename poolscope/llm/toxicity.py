"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Words that tell the classes apart are chosen by a likelihood-ratio test over all labelled documents of
the training folds, counted by Spark; bars are low, so that a small language has words of its own, and each
word weighs by its evidence. Each document is the TF-IDF vector of those words. A bounded
sample of labelled documents is the index: postings in blocks of examples with each word's largest
weight per block, so that a block whose bound is below the k-th best cosine is skipped, with exact
results. The votes of the neighbours, weighed by cosine, are mapped to the share of toxic documents that
labelled training documents with such a vote have, each judged without itself; that share is the score. The
neighbours' ids are the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, fold, words_on_workers
from poolscope.session import settled

BATCH_BYTES = 8_000_000
FOLDS, HELD_OUT = 3, 1
NEIGHBOURS = 15
EXAMPLES = 20_000
TERMS = 8_192
LEAST_RATIO = 15.0
LEAST_DOCS = 3
LEAST_LIFT = 3.0
QUERIES = 512
SMOOTHING = 1.0
VOTE_BINS = 1_000
PRIOR = 0.1
BLOCK = 64
HELD_WORDS = 200_000
BROADCAST_LABELS = 1_000_000

_letters = re.compile(r"[^\W\d_]+").findall


def terms_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _letters(text.lower()) if text else []


def term_table(rows: DataFrame) -> DataFrame:
    """term, n0, n1: in how many documents of each label a term occurs. rows: text, label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter(), Counter()]

        def table() -> pa.RecordBatch:
            every = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), *[pa.array([c[t] for t in every], pa.int64()) for c in held]], ["term", "n0", "n1"])
            held[0].clear()
            held[1].clear()
            return out

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held[label].update(set(terms_of(text)))
                if len(held[0]) + len(held[1]) > HELD_WORDS:
                    yield table()
        yield table()

    parts = rows.select("text", "label").mapInArrow(count, "term string, n0 long, n1 long")
    return parts.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def telling_terms(table: DataFrame, n0: int, n1: int, *, terms: int = TERMS, least: float = LEAST_RATIO,
                  least_docs: int = LEAST_DOCS, lift: float = LEAST_LIFT) -> list[tuple[str, float]]:
    """At most ``terms`` terms that label 1 has ``lift`` times as often, by likelihood ratio, with their weight.

    The weight is the inverse document frequency times the root of the ratio: a weakly proven term counts for less.
    """
    n = n0 + n1
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = n1 - a, n0 - b

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(a, n1 * (a + b) / n) + part(b, n0 * (a + b) / n) + part(c, n1 * (c + d) / n) + part(d, n0 * (c + d) / n))
    told = table.where((a + b >= least_docs) & (a * n0 >= lift * b * n1)).withColumn("ratio", ratio).where(F.col("ratio") >= least)
    best = told.orderBy(F.desc("ratio"), "term").limit(terms).collect()
    return [(r["term"], (math.log((n + 1) / (r["n0"] + r["n1"] + 1)) + 1) * math.sqrt(r["ratio"])) for r in best]


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, terms, counts: the document's numbers in the vocabulary, ascending, and how often they occur."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = [sorted(Counter([number[t] for t in terms_of(x) if t in number]).items()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([[p[i] for p in x] for x in found], pa.list_(pa.int32())) for i in (0, 1)]],
                ["doc_id", "terms", "counts"])

    return documents(docs, "doc_id", "text").mapInArrow(count, "doc_id long, terms array<int>, counts array<int>")


def unit_vector(terms: list[int], counts: list[int], idf: np.ndarray) -> np.ndarray:
    """Weights (1 + log count) x idf of the terms, of length 1."""
    w = (1 + np.log(np.array(counts, float))) * idf[terms]
    return w / np.sqrt((w * w).sum())


class BlockMaxIndex:
    """Examples with at least one term. ``nearest`` gives exactly the k best cosines, ties by example number."""

    def __init__(self, examples: list[tuple[int, list[int], list[int], int]], idf: np.ndarray, block: int = BLOCK):
        """examples: (doc_id, terms, counts, label); like ones lie together so that blocks have telling maxima."""
        examples = sorted(examples, key=lambda e: (e[1], e[2], e[0]))
        self.idf, self.block = idf, block
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[3] for e in examples], float)
        self.most_rows = int(np.unique(self.ids, return_counts=True)[1].max(initial=0))  # of one id
        self.most = np.zeros((-(-len(examples) // block), len(idf)))
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []  # by block: its terms, their weights by example
        for b in range(len(self.most)):
            dense = self.vectors([e[1:3] for e in examples[b * block : (b + 1) * block]])
            self.most[b] = dense.max(0)
            terms = np.flatnonzero(self.most[b])
            self.postings.append((terms, dense[:, terms].T.copy()))

    def vectors(self, documents: list[tuple[list[int], list[int]]]) -> np.ndarray:
        out = np.zeros((len(documents), len(self.idf)))
        for i, (terms, counts) in enumerate(documents):
            out[i, terms] = unit_vector(terms, counts, self.idf)
        return out

    def nearest(self, documents: list[tuple[list[int], list[int]]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document example numbers and cosines, best first; only examples that share a term.

        A document passes over all blocks whose bound is below its k-th best cosine so far, its best block first.
        """
        own = self.vectors(documents)
        bounds = np.zeros((len(own), len(self.most)))
        for i, (terms, _) in enumerate(documents):
            bounds[i] = self.most[:, terms] @ own[i, terms]
        # A cosine to nine places and an example number in one key, so that sorting keys sorts by both.
        best = np.zeros((len(own), k), np.int64)

        def visit(b: int, rows: np.ndarray) -> None:
            terms, weights = self.postings[b]
            cosines = np.rint((own[np.ix_(rows, terms)] @ weights) * 1e9).astype(np.int64)
            numbers = (1 << 32) - 1 - (b * self.block + np.arange(weights.shape[1]))
            keys = np.where(cosines > 0, (cosines << 32) + numbers, 0)
            best[rows] = -np.sort(-np.concatenate([best[rows], keys], 1), 1)[:, :k]

        if len(self.most):
            first = bounds.argmax(1)
            for b in np.unique(first):
                visit(b, np.flatnonzero(first == b))
            for b in np.argsort(-bounds.max(0), kind="stable"):
                least = (best[:, -1] >> 32) * 1e-9
                rows = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= least - 2e-9) & (first != b))
                if len(rows):
                    visit(b, rows)
        return [((1 << 32) - 1 - (row[row > 0] & ((1 << 32) - 1)), (row[row > 0] >> 32) * 1e-9) for row in best]


def vote_of(labels: np.ndarray, cosines: np.ndarray, share: float) -> float:
    """Share of label 1 among neighbours, weighed by cosine and drawn to ``share``."""
    return float((cosines @ labels + SMOOTHING * share) / (cosines.sum() + SMOOTHING))


def vote_bins(taught: DataFrame, shared: Broadcast, k: int, share: float) -> DataFrame:
    """x, n, n1: mean log-odds of the votes of a bin, documents and those of label 1. taught: doc_id, terms, counts, label.

    Each document's neighbours are the k nearest examples with another id.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keys = [(tuple(t), tuple(c)) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                rows.setdefault(key, []).append(i)
            ids, distinct, odds = batch.column("doc_id").to_pylist(), list(rows), np.zeros(len(keys))
            for i in range(0, len(distinct), QUERIES):
                part = distinct[i : i + QUERIES]
                for key, (at, cosines) in zip(part, index.nearest([(list(t), list(c)) for t, c in part], k + index.most_rows), strict=True):
                    for row in rows[key]:
                        others = np.flatnonzero(index.ids[at] != ids[row])[:k]
                        v = vote_of(index.labels[at[others]], cosines[others], share)
                        odds[row] = math.log(v / (1 - v))
            yield pa.RecordBatch.from_arrays([pa.array(odds), batch.column("label")], ["x", "label"])

    votes = taught.select("doc_id", "terms", "counts", "label").mapInArrow(judge, "x double, label int")
    bins = votes.groupBy(F.floor(VOTE_BINS / (1 + F.exp(-F.col("x")))).alias("bin"))
    return bins.agg(F.avg("x").alias("x"), F.count("*").alias("n"), F.sum("label").alias("n1"))


def calibration(x: np.ndarray, n: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """a, b >= 0 so that 1 / (1 + exp(-(a + b x))) is the share of label 1 at log-odds x; without documents, 0 and 1.

    Logistic regression with Platt's targets and a slight pull to a = 0, b = 1, so that a single class has an answer.
    """
    if not n.sum():
        return 0.0, 1.0
    high, low = (n1.sum() + 1) / (n1.sum() + 2), 1 / ((n - n1).sum() + 2)
    hits, both, start = n1 * high + (n - n1) * low, np.stack([np.ones(len(x)), x]), np.array([0.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = w @ both
        return float((n * np.logaddexp(0, z) - hits * z).sum() + PRIOR / 2 * ((w - start) ** 2).sum())

    w = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-(w @ both)))
        step = np.linalg.solve((both * (n * p * (1 - p))) @ both.T + PRIOR * np.eye(2), both @ (n * p - hits) + PRIOR * (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(size * step).max() < 1e-9:
            break
    if w[1] < 0:
        return float(np.log(hits.sum() / (n.sum() - hits.sum()))), 0.0
    return float(w[0]), float(w[1])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, k: int = NEIGHBOURS, examples: int = EXAMPLES, terms: int = TERMS,
    folds: int = FOLDS, held_out: int = HELD_OUT,
) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), evidence and cosines of the neighbours, per row of documents.

    Learns ``labels.toxic`` from rows whose crc32(doc_id) mod ``folds`` is not ``held_out``. Bounds: the ``examples``
    labelled training rows that come first by a hash of their id are the index, and the ``terms`` most telling
    words the vocabulary; the choice of words counts all labelled training documents. A document without a
    telling word has the examples without one as neighbours, all alike; so have null and empty texts. The map from
    vote to score is fitted on all labelled training rows that have a telling word. With no labelled training
    rows all scores are 0.5. Null labels are left out; a document labelled twice counts twice; a null
    doc_id is scored, held_out false. Repeated rows are scored each. Runs jobs when called.
    """
    spark = docs.sparkSession
    words_on_workers(spark)
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("label"))
    known = settled(known.where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)))
    few = known.count() <= BROADCAST_LABELS
    rows = documents(docs, "doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    chosen = telling_terms(term_table(rows), n0, n1, terms=terms) if n0 and n1 else []
    vocabulary, idf = [t for t, _ in chosen], np.array([w for _, w in chosen])
    counted = settled(term_counts(docs, vocabulary))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(examples)
    taken = counted.join(sample, "doc_id")
    index = BlockMaxIndex([tuple(r) for r in taken.where(F.size("terms") > 0).select("doc_id", "terms", "counts", "label").collect()], idf)
    blank = taken.where(F.size("terms") == 0).agg(F.count("*").alias("n"), F.sum("label").alias("n1")).first()
    share = (n1 + 1) / (n0 + n1 + 2)
    plain = ((blank["n1"] or 0) + SMOOTHING * share) / (blank["n"] + SMOOTHING)
    shared = spark.sparkContext.broadcast(index)
    taught = counted.where(F.size("terms") > 0).join(F.broadcast(known) if few else known, "doc_id")
    bins = vote_bins(taught, shared, k, share).collect() if vocabulary else []
    a, b = calibration(*[np.array([r[c] for r in bins], float) for c in ("x", "n", "n1")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keys = [(tuple(t), tuple(c)) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            distinct = [x for x in dict.fromkeys(keys) if x[0]]
            done: dict[tuple, tuple] = {((), ()): (plain, [], [])}
            for i in range(0, len(distinct), QUERIES):
                part = distinct[i : i + QUERIES]
                for key, (at, cosines) in zip(part, index.nearest([(list(t), list(c)) for t, c in part], k), strict=True):
                    vote = vote_of(index.labels[at], cosines, share)
                    calibrated = 1 / (1 + math.exp(-(a + b * math.log(vote / (1 - vote)))))
                    done[key] = calibrated, index.ids[at].tolist(), cosines.tolist()
            out = [done[key] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.float64()),
                 pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                ["doc_id", "score", "evidence", "cosines"])

    scored = counted.mapInArrow(score, "doc_id long, score double, evidence array<long>, cosines array<double>")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "cosines")
