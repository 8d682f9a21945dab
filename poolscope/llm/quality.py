"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Statistics of each whole text, brought to roughly normal shape by logarithms and log-odds, are computed
once. Class means and covariances come from sums that partitions compute and Spark adds up, over all
labelled rows of the training folds. Each covariance is shrunk towards the pooled one and the
diagonal; a score is the logistic function of the difference of the two classes' log-densities, whose
Mahalanobis distances use Cholesky factors computed once on the driver (a few hundred numbers).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, fold, release, words, words_on_workers
from poolscope.session import settled

BATCH_BYTES = 8_000_000
POOLED_SHARE = 0.1
DIAGONAL_SHARE = 0.05
FOLDS, HELD_OUT = 3, 1
CHUNK = 1_000_000

_UPPER = list(range(65, 91))
_LETTERS = _UPPER + list(range(97, 123)) + list(range(128, 256))
_DIGITS = list(range(48, 58))
_BREAKS = [10]
_BLANKS = [9, 11, 12, 13, 32]
_STOPS = [ord(c) for c in ".,;:?"]
_LOUD = [ord("!")]
_BARS = [ord("|")]
_SIGNS = [ord(c) for c in "#*$%&<>{}[]\\/=+~^_@`"]
STATISTICS = 15


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def _packed(data: bytes) -> int:
    """Bytes after compression, of all the text, a stretch at a time."""
    return sum(len(zlib.compress(data[i : i + CHUNK], 1)) for i in range(0, len(data), CHUNK))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; defined for empty texts too."""
    data = text.encode()
    n = len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    own = words(text)
    lines = [x for x in text.split("\n") if x.strip()]
    n_words, n_lines = len(own), len(lines)
    kinds = [int(count[k].sum()) for k in (_LETTERS, _DIGITS, _BLANKS, _STOPS, _LOUD, _BARS, _SIGNS)]
    seen = set(own)
    return [
        float(np.log1p(n_words)),
        float(np.log((sum(map(len, own)) + 1) / (n_words + 1))),
        *[_odds(k, n) for k in kinds],
        _odds(int(count[_UPPER].sum()), kinds[0]),
        float(np.log((len(seen) + 1) / (n_words + 1))) + 0.1 * float(np.log1p(n_words)),
        _odds(n_lines - len(set(lines)), n_lines),
        float(np.log((n + 1) / (n_lines + 1))),
        float(np.log((_packed(data) + 10) / (n + 10))),
        _odds(sum(x[:1].isupper() for x in own), n_words),
    ]


def document_statistics(docs: DataFrame, *, whole: bool = False) -> DataFrame:
    """doc_id and stats (array of doubles) of each row, null text as empty. Reads each text once.

    With ``whole`` the text too, and all other columns as the struct _rest.
    """
    words_on_workers(docs.sparkSession)
    own = documents(docs, "doc_id", "text")
    if whole:
        own = docs.select("doc_id", docs["text"].cast("string").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"))
    kept = ["doc_id", "text", "_rest"] if whole else ["doc_id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(rows, pa.list_(pa.float64()))], [*kept, "stats"])
        release()

    return own.mapInArrow(measure, own.select(*kept).withColumn("stats", F.array().cast("array<double>")).schema)


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By label: count, sum and sum of outer products of stats. rows: stats, label (0 or 1)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("stats").to_pylist(), float).reshape(len(labels), -1)
            for label in np.unique(labels):
                own = np.c_[np.ones((labels == label).sum()), x[labels == label]]
                total[int(label)] = total.get(int(label), 0) + own.T @ own
        for label, sums in total.items():
            flat = sums.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)],
                ["label", "at", "value"])

    parts = rows.mapInArrow(add_up, "label int, at int, value double")
    found: dict[int, list[tuple[int, float]]] = {}
    for label, at, value in parts.groupBy("label", "at").agg(F.sum("value")).collect():  # at most 2 x 16 x 16 rows
        found.setdefault(label, []).append((at, value))
    out = {}
    for label, cells in found.items():
        m = np.array([v for _, v in sorted(cells)])
        m = m.reshape(int(len(m) ** 0.5), -1)
        out[label] = m[0, 0], m[0, 1:], m[1:, 1:]
    return out


@dataclass
class Discriminant:
    """Two Gaussian classes. Without both classes in training all scores are the smoothed share of label 1."""

    prior: float
    means: list[np.ndarray]
    factors: list[np.ndarray]

    @staticmethod
    def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED_SHARE,
            diagonal: float = DIAGONAL_SHARE) -> Discriminant:
        n = [sums[k][0] if k in sums else 0 for k in (0, 1)]
        prior = (n[1] + 1) / (n[0] + n[1] + 2)
        if min(n) < 2:
            return Discriminant(prior, [], [])
        means = [sums[k][1] / n[k] for k in (0, 1)]
        own = [sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        both = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
        factors = []
        for cov in own:
            cov = (1 - pooled) * cov + pooled * both
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
            # The inverse of the factor, so that a batch of distances is one product.
            factors.append(np.linalg.inv(np.linalg.cholesky(cov)))
        return Discriminant(prior, means, factors)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(stats), self.prior)
        density = [np.log(np.diag(f)).sum() - 0.5 * (((stats - m) @ f.T) ** 2).sum(1)
                   for m, f in zip(self.means, self.factors, strict=True)]
        odds = np.clip(density[1] - density[0] + np.log(self.prior / (1 - self.prior)), -500, 500)
        return 1 / (1 + np.exp(-odds))


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher for label 1), predicted (score >= 0.5) of each row of documents.

    Learns ``labels.quality`` from rows whose crc32(doc_id) mod ``folds`` is not ``held_out``; statistics of the
    text are the only inputs. Null labels and labels of absent documents are left out, a document labelled
    twice counts twice. Null or empty texts have statistics and so a score. A null doc_id is in no fold: it
    is scored, not learnt from, held_out false. Repeated rows are scored each. Without training rows of both labels all
    scores are the smoothed share of label 1. Runs jobs when called; reads each text once.
    """
    stats = settled(document_statistics(docs))
    model = _fitted(stats, labels, folds, held_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch))], ["doc_id", "score"])

    scored = stats.select("doc_id", "stats").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _fitted(stats: DataFrame, labels: DataFrame, folds: int, held_out: int) -> Discriminant:
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    return Discriminant.fit(class_sums(stats.select("doc_id", "stats").join(known, "doc_id").select("stats", "label")))


def _scores(model: Discriminant, batch: pa.RecordBatch) -> np.ndarray:
    return model.score(np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, -1))


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """The rows of documents, all columns, whose own text scores at least ``least``.

    Each row is judged by itself, whatever its doc_id is: null ids and rows that share an id too. Texts of any length
    are measured whole; null and empty texts have a score; other cases as in ``quality_scores``. Runs jobs when called.
    """
    stats = settled(document_statistics(docs, whole=True))
    model = _fitted(stats, labels, folds, held_out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["text", "_rest"]).filter(pa.array(_scores(model, batch) >= least))

    good = stats.mapInArrow(judge, stats.select("text", "_rest").schema)
    return good.select(*[F.col("text").cast(docs.schema[c].dataType) if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])
