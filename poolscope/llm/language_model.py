"""Log-likelihood of whole documents under a gated recurrent language model trained on the corpus.

Spark counts every word of all training documents. The most frequent are head words of the recurrent
model (recurrent.py); all others belong to rare classes by how they end, and within its class a word
has its smoothed share of the class's count, so every text has a probability. Training is data-parallel:
from a start fitted on a bounded sample, each task makes one pass over all training documents it holds,
and Spark averages the weights by tokens, a slice a task. Scoring looks up frequent words in a
dictionary of bounded size; the counts of the others come from a join by word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm import recurrent as R
from poolscope.llm.common import by_bytes, documents, fold, words_on_workers
from poolscope.session import settled

FOLDS, HELD_OUT = 7, 2
HEADS = 1024
MEMBERS = 64
ENDINGS, STEMS = 4, 12
DICTIONARY = 300_000
SAMPLE = 2_000
PASS_RATE = 0.003
BUFFER = 3_000_000
BATCH_BYTES = 8_000_000
SEGMENT = 4_000_000
HELD_WORDS = 300_000
SLICES = 16
PART_TOKENS, MOST_PARTS = 2_000_000, 16_384
END = b""


def tokens_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, in lists of a bounded size, without the end."""
    data = (text or "").encode().lower()  # of bytes, only ASCII letters change
    start = 0
    while len(data) - start > SEGMENT:
        cut = data.find(b" ", start + SEGMENT)
        if cut < 0:
            break
        yield data[start:cut].split()
        start = cut
    yield data[start:].split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, A-Z in lower case, and how many each text has; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # blanks at either end leave an empty string
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    bounds = bounds - bounds[0]
    return flat.filter(full), upto[bounds[1:]] - upto[bounds[:-1]]


#: By last byte: letter 0, full stop 1, comma 2, other 3.
_ENDING = [1 if b == 46 else 2 if b == 44 else 0 if 97 <= b <= 122 or b >= 128 else 3 for b in range(256)]


def rare_class(word: bytes) -> int:
    """A class by what a word ends with: letter, full stop, comma or other, and the two bytes before."""
    ending = _ENDING[word[-1]] if word else 3
    stem = word.rstrip(b".,;:!?|#*$%&<>") if ending else word
    return ending * STEMS + zlib.crc32(stem[-2:]) % STEMS


def word_counts(docs: DataFrame) -> DataFrame:
    """word, kind (its rare class), n over all rows of docs; the end of a document is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(map(rare_class, held), pa.int32()), pa.array(held.values(), pa.int64())],
                ["word", "kind", "n"])
            held.clear()
            return out

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for text in batch.column("text").to_pylist():
                for own in tokens_of(text):
                    held.update(own)
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield table()
        if held:
            yield table()

    parts = docs.select("text").mapInArrow(count, "word string, kind int, n long")
    return parts.groupBy("word", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What a worker needs of the counts: the dictionary's words, and sums over all words."""

    shape: R.Shape
    words: pa.Array  # heads first
    end: int  # the place of the end
    log_count: np.ndarray  # log10(c + 1) by place
    number: np.ndarray  # token number by place
    log_base: float  # log10(N + V + 1)
    log_rare: np.ndarray  # log10 of the smoothed total, by rare class

    def numbers(self, texts: pa.Array) -> Numbers:
        flat, lengths = split(texts)
        at = pc.index_in(flat, value_set=self.words).fill_null(-1).to_numpy()
        missing = np.flatnonzero(at < 0)
        others = flat.take(pa.array(missing)).dictionary_encode()
        rare = np.array([self.shape.heads + rare_class(w.encode()) for w in others.dictionary.to_pylist()], np.int64)
        codes = others.indices.to_numpy()
        number = self.number[at]
        number[missing] = rare[codes]
        ends = np.cumsum(lengths)
        starts = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1))[:-1]])
        pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[missing] * (len(rare) + 1) + codes, return_counts=True)
        texts_of, words_of = np.divmod(pairs, len(rare) + 1)
        return Numbers(np.insert(number, ends, self.number[self.end]), np.insert(at, ends, self.end), starts, lengths + 1,
                       np.searchsorted(texts_of, np.arange(len(lengths) + 1)), others.dictionary.take(pa.array(words_of)), times)


@dataclass
class Numbers:
    """Texts as numbers, one after the other, each with its end."""

    number: np.ndarray  # token numbers
    place: np.ndarray  # in the dictionary, -1: not there
    starts: np.ndarray  # by text
    lengths: np.ndarray  # by text
    bounds: np.ndarray  # of each text in what follows
    others: pa.Array  # distinct words that aren't in the dictionary
    times: np.ndarray  # how often


def vocabulary(counts: DataFrame, heads: int = HEADS, size: int = DICTIONARY) -> tuple[Vocabulary, np.ndarray, int, int]:
    """The vocabulary, training counts by token number, N, and the least count of the dictionary's words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    best = counts.orderBy(F.col("word") != "", F.desc("n"), "word").limit(heads).collect()
    best = [(r["word"].encode(), r["n"]) for r in best] or [(END, 0)]
    # The least count that keeps the dictionary within its size, from the numbers of words by count.
    least, room = 1 << 62, size
    for n, many in counts.groupBy("n").count().orderBy(F.desc("n")).collect():
        if many > room:
            break
        least, room = n, room - many
    known = {w: n for w, n in best}
    for r in counts.where(F.col("n") >= least).select("word", "n").toArrow().to_pylist():
        known.setdefault(r["word"].encode(), r["n"])
    rare = ENDINGS * STEMS
    in_heads = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w.decode(),) for w, _ in best], "word string")), "word", "left_anti")
    sums = {r["kind"]: r for r in in_heads.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    by_rare = np.array([sums[k]["n"] if k in sums else 0 for k in range(rare)], float)
    words = np.array([sums[k]["v"] if k in sums else 0 for k in range(rare)], float)
    shape = R.Shape(len(best), min(MEMBERS, len(best)), rare)
    numbers = np.array([i if i < len(best) else len(best) + rare_class(w) for i, w in enumerate(known)], np.int64)
    places = list(known)
    found = Vocabulary(shape, pa.array([w.decode() for w in places], pa.string()), places.index(END), np.log10(np.array(list(known.values()), float) + 1), numbers,
                       math.log10(total["n"] + total["v"] + 1), np.log10(by_rare + words + 1))
    return found, np.concatenate([[float(n) for _, n in best], by_rare]), total["n"], least


def training_parts(tokens: int) -> int:
    """Tasks of the training pass: by what there is to learn, so the weights don't depend on how files are cut."""
    return max(1, min(MOST_PARTS, -(-tokens // PART_TOKENS)))


def train(docs: DataFrame, vocab, start, rate: float, parts: int | None = None) -> dict[str, np.ndarray]:
    """Weights after one pass of each task over its documents from ``start``, averaged by tokens.

    vocab, start: broadcast variables. Documents travel as token numbers, dealt to ``parts`` tasks by a hash of id and text
    and ordered by it; without ``parts`` they stay where they are. Weights are averaged in slices, so no task holds them of
    all tasks.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            made = vocab.value.numbers(batch.column("text"))
            flat = made.number.astype("<u2").tobytes()
            ids = [flat[2 * s : 2 * (s + n)] for s, n in zip(made.starts.tolist(), made.lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(ids, pa.binary())], ["hash", "ids"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, size = R.Trainer(start.value, vocab.value.shape, rate), [], 0
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                held.append(np.frombuffer(ids, "<u2").astype(np.int32))
                size += len(held[-1])
                if size >= BUFFER:
                    trainer.fit(held)
                    held, size = [], 0
        if held:
            trainer.fit(held)
        if trainer.tokens:
            flat = np.concatenate([v.ravel() for v in trainer.p.values()]).astype(float) * trainer.tokens
            parts = np.array_split(flat, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([trainer.tokens] * SLICES, pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))],
                ["slice", "tokens", "weights"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = total.setdefault(row["slice"], [0, 0.0])
                own[0] += row["tokens"]
                own[1] = own[1] + np.array(row["weights"])
        for k, (tokens, weights) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([tokens], pa.int64()), pa.array([weights.tolist()], pa.list_(pa.float64()))], ["slice", "tokens", "weights"])

    kind = "slice int, tokens long, weights array<double>"
    # Sorted, so that sums of floating-point numbers don't depend on the order of arrival.
    numbered = docs.select(F.xxhash64("doc_id", "text").alias("hash"), "text").mapInArrow(number, "hash long, ids binary")
    if parts:
        numbered = numbered.repartition(parts, "hash").sortWithinPartitions("hash", "ids")
    dealt = numbered.mapInArrow(fit, kind).repartition(SLICES, "slice").sortWithinPartitions("slice", "tokens", "weights")
    rows = sorted(dealt.mapInArrow(add_up, kind).collect())
    if not rows:
        return start.value
    flat, out, i = np.concatenate([np.array(w) / n for _, n, w in rows]).astype(np.float32), {}, 0
    for k, v in start.value.items():
        out[k] = flat[i : i + v.size].reshape(v.shape)
        i += v.size
    return out


def score_texts(docs: DataFrame, vocab, model) -> DataFrame:
    """doc_id, n_tokens, n_known, base, score so far, and the words that aren't in the dictionary, with how often."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, size = vocab.value, [], 0
        known_log, heads = np.append(v.log_count, 0.0), v.shape.heads

        def scored() -> Iterator[pa.RecordBatch]:
            texts = [made.number[s : s + n].astype(np.int32) for _, made, _ in held for s, n in zip(made.starts, made.lengths, strict=True)]
            found, done = R.log_probabilities(model.value, v.shape, texts) / math.log(10), 0
            for ids, made, (n_known, base, extra) in held:
                score = extra + found[done : done + len(ids)]
                done += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(made.lengths, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(made.bounds, pa.int32()), made.others),
                     pa.ListArray.from_arrays(pa.array(made.bounds, pa.int32()), pa.array(made.times, pa.int32()))],
                    ["doc_id", "n_tokens", "n_known", "base", "score", "others", "times"])

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            made = v.numbers(batch.column("text"))
            logs, rare = known_log[made.place], made.number >= heads
            extra = np.zeros(len(logs))
            extra[rare] = logs[rare] - v.log_rare[made.number[rare] - heads]
            sums = [np.add.reduceat(x, made.starts) for x in ((logs > 0).astype(np.int64), logs - v.log_base, extra)]
            made.place = None
            held.append((batch.column("doc_id"), made, sums))
            size += len(made.number)
            if size >= BUFFER:
                yield from scored()
                held, size = [], 0
        if held:
            yield from scored()

    return documents(docs, "doc_id", "text").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, base double, score double, others array<string>, times array<int>")


def log_likelihoods(docs: DataFrame, *, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of documents.

    Learns from the rows whose crc32(doc_id) mod ``folds`` is not ``held_out``: counts and the training pass cover all
    of them; only the start is fitted on the ``sample`` that come first by a hash of their id. Null or empty
    texts are one end. A null doc_id is in no fold: scored, not learnt from, held_out false. Repeated rows are
    learnt from and scored each. Without training rows nothing is known and base and score are 0 for each
    token's share of words. An empty table gives an empty result. Runs jobs when called.
    """
    spark = docs.sparkSession
    words_on_workers(spark)
    own = documents(docs, "doc_id", "text")
    training = own.where(fold(F.col("doc_id"), folds) != held_out)
    counts = settled(word_counts(training))
    found, by_number, n_train, least = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(found)
    first = training.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    start = spark.sparkContext.broadcast(R.initial(found.shape, by_number))
    # Found by many tasks; only the small table goes through one, in an order that files don't decide.
    few = settled(training.join(F.broadcast(first), "doc_id", "left_semi"))
    few = few.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    warm = train(few, vocab, start, R.RATE)
    model = spark.sparkContext.broadcast(train(training, vocab, spark.sparkContext.broadcast(warm), PASS_RATE, training_parts(n_train)))

    scored = settled(score_texts(own, vocab, model).withColumn("_row", F.monotonically_increasing_id()))
    each = scored.select("_row", F.explode(F.arrays_zip("others", "times")).alias("_o")).select("_row", "_o.others", "_o.times")
    rest = counts.where(F.col("n") < least).select("word", "n")
    more = each.join(rest, F.col("others") == F.col("word")).groupBy("_row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_log"))
    both = scored.drop("others", "times").join(more, "_row", "left")
    known, log = F.coalesce("_known", F.lit(0)), F.coalesce("_log", F.lit(0.0))
    return both.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"))
