"""Quality rules with thresholds that adapt to language and source, from mergeable quantile sketches.

A sketch counts values in buckets of bounded relative width (a value's bucket is the ceiling of its
logarithm), so a quantile is right to within that width; sketches of parts merge by adding counts, which
is what Spark's partial aggregation does, and give the same result in any order. Each language and source
has one per statistic, with its language's sketch merged in at the weight of a few rows, and each language so
with that of everything: thresholds of a small group move to its own as it grows, with no size at which they
jump. A document is rejected where a statistic lies far outside its group's quartiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, words, words_on_workers
from poolscope.session import settled

BATCH_BYTES = 8_000_000
ACCURACY = 0.01
PRIOR_ROWS = 50  # weight of the sketch above in each group's
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "#*$%&|<>"  # fixed values

#: Statistic, expression, the sides on which it may be too far out, spreads of the quartiles allowed, and the least
#: distance from the median that is rejected: a group whose values hardly differ has no spread to go by.
RULES = [
    ("word_length", "word_chars / n_words", "both", 4.0, 1.0),
    ("symbols_per_word", "n_symbols / n_words", "high", 4.0, 0.1),
    ("duplicate_lines", "n_dup_lines / n_lines", "high", 4.0, 0.5),
    ("repeated_words", "n_repeat_words / n_words", "high", 4.0, 0.25),
]


def repeated_words(own: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(own) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in own], np.int64, len(own))
    if len(number) == len(own):
        return 0
    # Windows of 2, 4, 8 words get numbers of their own, so equal numbers are equal windows.
    span = 1
    while span < window:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span *= 2
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines with a word."""
    own = words(text)
    lines = [x for x in text.split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    return (len(own), sum(map(len, own)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(own), len(lines))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row's whole text; a null text has none."""
    words_on_workers(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows = [text_counts(t or "") for t in batch.column("text").to_pylist()]
            found = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "lang", "source")], *found], ["doc_id", "lang", "source", *names])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names)
    own = documents(docs, "doc_id", "text", "lang", "source")
    own = own.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return own.mapInArrow(count, schema)


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """The sketch's bucket of a value of at least 0; values below 1e-9 share one."""
    return F.when(value <= 1e-9, F.lit(-(1 << 20))).otherwise(F.ceil(F.log(value) / math.log((1 + accuracy) / (1 - accuracy)))).cast("int")


def bucket_value(at: Column, accuracy: float = ACCURACY) -> Column:
    """A value within ``accuracy`` of all in the bucket."""
    gamma = (1 + accuracy) / (1 - accuracy)
    return F.when(at == -(1 << 20), 0.0).otherwise(2 * F.pow(F.lit(gamma), at) / (gamma + 1))


def sketches(rows: DataFrame, keys: list[str], statistics: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """keys, statistic, bucket, n. Sketches of disjoint rows merge by summing n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in statistics]))
    each = rows.select(*keys, pairs.alias("_p")).select(*keys, "_p.statistic", bucket(F.col("_p.value"), accuracy).alias("bucket"))
    return each.groupBy(*keys, "statistic", "bucket").agg(F.count("*").alias("n"))


def quantiles(merged: DataFrame, keys: list[str], at: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """keys, statistic, n_rows and q0, q1, ... for the wanted shares: the value at rank ceil(share * n)."""
    group = W.partitionBy(*keys, "statistic")
    ranked = merged.withColumn("_upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("_all", F.sum("n").over(group))
    # n may be a weight; sums of the same weights in another order differ by far less than the margin.
    found = [F.min(F.when(F.col("_upto") >= F.col("_all") * (q * (1 - 1e-9)), F.col("bucket"))).alias(f"q{i}") for i, q in enumerate(at)]
    out = ranked.groupBy(*keys, "statistic").agg(F.max("_all").alias("n_rows"), *found)
    return out.select(*keys, "statistic", "n_rows", *[bucket_value(F.col(f"q{i}"), accuracy).alias(f"q{i}") for i in range(len(at))])


def pooled(own: DataFrame, keys: list[str], above: DataFrame, shared: list[str], prior_rows: float) -> DataFrame:
    """Each group's sketch with the one ``above`` it merged in, scaled to ``prior_rows`` rows.

    own: keys, statistic, bucket, n. above: shared (some of the keys), statistic, bucket, n; null keys are keys like others.
    """
    rows = W.partitionBy(*shared, "statistic")
    scaled = above.select(*[F.col(k).alias(f"_{k}") for k in shared], F.col("statistic").alias("_statistic"), "bucket",
                          (F.col("n") * (prior_rows / F.sum("n").over(rows))).alias("n"))
    groups = own.select(*keys, "statistic").distinct()
    same = F.col("statistic") == F.col("_statistic")
    for k in shared:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    lent = groups.join(scaled, same).select(*keys, "statistic", "bucket", "n")
    both = own.withColumn("n", F.col("n").cast("double")).unionByName(lent)
    return both.groupBy(*keys, "statistic", "bucket").agg(F.sum("n").alias("n"))


def thresholds(rows: DataFrame, *, prior_rows: float = PRIOR_ROWS, accuracy: float = ACCURACY) -> DataFrame:
    """lang, source, and low_s and high_s for each statistic s. rows: lang, source and the statistics, none null."""
    own = sketches(rows, ["lang", "source"], [r[0] for r in RULES], accuracy)
    total = F.sum("n").alias("n")
    by_lang = own.groupBy("lang", "statistic", "bucket").agg(total)
    by_lang = pooled(by_lang, ["lang"], own.groupBy("statistic", "bucket").agg(total), [], prior_rows)
    merged = pooled(own, ["lang", "source"], by_lang, ["lang"], prior_rows)
    found = quantiles(merged, ["lang", "source"], [0.25, 0.5, 0.75], accuracy)
    picked = found.select("lang", "source", "statistic", F.struct("q0", "q1", "q2").alias("q"))
    out = []
    for name, _, sides, spreads, least in RULES:
        q0, q1, q2 = (F.col(f"q.q{i}") for i in range(3))
        reach = F.greatest(spreads * (q2 - q0), F.lit(least))
        own_rule = F.col("statistic") == name
        out.append(F.max(F.when(own_rule, q1 + reach)).alias(f"high_{name}"))
        if sides == "both":
            out.append(F.max(F.when(own_rule, q1 - reach)).alias(f"low_{name}"))
    return picked.groupBy("lang", "source").agg(*out)


def apply_rules(docs: DataFrame, *, prior_rows: float = PRIOR_ROWS, accuracy: float = ACCURACY) -> DataFrame:
    """Counts, base_failed and kept of each row of documents, with the statistics and the rules it broke.

    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. Sketches are taken over the
    documents that pass this; the others are never kept. A group's thresholds are those of its documents and
    ``prior_rows`` rows shaped like its language's, which has as many shaped like all documents. Null languages
    and sources are groups of their own. Null or empty texts have no words and fail; very long texts are judged
    whole; a value equal to a threshold stays. Repeated rows, and rows that share an id, are judged each and count
    each; further columns, whatever their names, are ignored; an empty table gives an empty result. Runs a job
    when called; reads each text once.
    """
    counted = settled(document_counts(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed)
    measured = rows.where(~F.col("base_failed")).select("*", *[F.expr(f"CAST({e} AS DOUBLE)").alias(s) for s, e, *_ in RULES])
    limits = thresholds(measured, prior_rows=prior_rows, accuracy=accuracy)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # A hot source's rows all meet the same row of limits; the join splits them, or sends the limits around if small.
    same = rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"])
    broken = []
    for name, expression, sides, _, _ in RULES:
        value = F.expr(expression)
        out = value > F.col(f"high_{name}")
        if sides == "both":
            out = out | (value < F.col(f"low_{name}"))
        broken.append(F.when(~F.col("base_failed") & out, F.lit(name)))
    judged = rows.join(limits, same, "left").withColumn("broken", F.array_compact(F.array(*broken)))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))
