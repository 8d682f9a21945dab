"""Groups of spelling variants: words one letter apart, found in a bit-sliced position index.

A block of the vocabulary is indexed as bitsets: for each (position, letter) the words that have the
letter there, and for each length the words that long. A query word is read letter by letter; bitsets of
the words that match so far, with no error, with a letter replaced, with one inserted (their position is
one ahead) and with one missing (one behind), move on together, all words of the block at once.

The vocabulary is dealt into blocks so that two near words always meet: one error leaves either the first
3 letters or the last 4 alone (of words of 64 letters or more, the first 32 or the last 32). Large blocks
are cut into tiles of a chunk of queries and a chunk of index, so no beginning or ending is one task's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, words_on_workers
from poolscope.session import settled

LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
ODDS = 31
CHUNK = 4096
CHUNK_LETTERS = 262_144
HELD_WORDS = 200_000
HELD_ROWS = 20_000
BATCH_BYTES = 4_000_000
# Pieces of short and of long words that one error leaves alone, by kind of block.
LONG = 64
FRONT, BACK, LONG_PIECE = 3, 4, 32

#: Latin-1 bytes of letters in lower case (A to Z only), all others as blanks.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


@lru_cache
def _runs(least: int):
    return re.compile(rb"[^ ]{%d,}" % least).findall


def variants(doc_id: int | None, text: str | None, least: int = LEAST_CHARS) -> Iterator[tuple[bytes, int]]:
    """Runs of letters of a text with their counts, some with a letter deleted, as latin-1 bytes."""
    runs = _runs(least)((text or "").encode("latin-1", "replace").translate(_LETTERS))
    head = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs).items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % ODDS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def vocabulary(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n for each word of at least ``least_chars`` letters found at least ``least_count`` times."""
    words_on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def table() -> pa.RecordBatch:
            names = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([names, pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in variants(doc_id, text, least_chars):
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS:
                yield table()
        if held:
            yield table()

    counted = documents(docs, "doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets over a list of words; bit k stands for the k-th word."""

    def __init__(self, words: list[str]):
        self.at: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0))]
        self.of_length: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
            for letters, letter in zip(self.at, word, strict=False):
                letters[letter] = letters.get(letter, 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, queries: list[str]) -> Iterator[tuple[str, int]]:
        """Each query, in order, with the words that have exactly one letter inserted, deleted or replaced.

        What queries that follow each other begin with alike is read once.
        """
        # After i letters: the words that match, with a letter replaced, one more letter, one fewer.
        states = [(self.all, 0, 0, 0)]
        read, of, end = "", self.of_length, len(self.at)
        for query in queries:
            known = 0
            for a, b in zip(read, query, strict=False):
                if a != b:
                    break
                known += 1
            del states[known + 1 :]
            read = query
            for i in range(len(states) - 1, len(query)):
                same, replaced, longer, shorter = states[i]
                letter = query[i]
                match = self.at[i].get(letter, 0) if i < end else 0
                shorter = same | (shorter and shorter & self.at[i - 1].get(letter, 0) if i <= end else 0)
                longer |= same
                longer = longer and longer & self.at[i + 1].get(letter, 0) if i + 1 < end else 0
                replaced = (replaced and replaced & match) | (same and same & ~match)
                same = same and same & match
                states.append((same, replaced, longer, shorter))
                if not (same or replaced or longer or shorter):
                    read = query[: i + 1]
                    break
            same, replaced, longer, shorter = states[-1]
            n = len(query)
            yield query, replaced & of.get(n, 0) | (longer | same) & of.get(n + 1, 0) | shorter & of.get(n - 1, 0)


def near_in_tile(kind: str, queries: list[str], words: list[str], counts: list[int]) -> list[tuple[str, int, int, str]]:
    """For each query with near words in the tile: how many, and the largest count with its word.

    A pair that blocks of more than one kind hold is found in one of them only. Blocks by ending read words
    backwards.
    """
    # With the most frequent words first, the lowest bit is the best one.
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    words, counts = [words[k] for k in order], [counts[k] for k in order]
    backwards = kind in "bB"
    front = LONG_PIECE if kind in "FB" else FRONT
    beginning: dict[str, int] = {}
    if backwards:
        for k, word in enumerate(words):
            beginning[word[:front]] = beginning.get(word[:front], 0) | 1 << k
        index, asked = PositionIndex([w[::-1] for w in words]), sorted(q[::-1] for q in queries)
    else:
        index, asked = PositionIndex(words), sorted(queries)
    out = []
    for query, near in index.near(asked):
        if not near:
            continue
        if backwards:
            query = query[::-1]
            near &= ~beginning.get(query[:front], 0)
        if kind in "fb" and len(query) == LONG:
            near &= ~index.of_length.get(LONG, 0)
        if near:
            best = (near & -near).bit_length() - 1
            out.append((query, near.bit_count(), counts[best], words[best]))
    return out


def near_words(words: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, best_n and best for each of ``words`` (word, n; each word once) that has a near word."""
    words_on_workers(words.sparkSession)
    size = F.char_length("word")
    pieces = lambda kinds, front, back: F.array(
        F.concat(F.lit(kinds[0]), F.substring("word", 1, front)), F.concat(F.lit(kinds[1]), F.right("word", F.lit(back)))
    )
    none = F.array().cast("array<string>")
    keys = F.concat(
        F.when(size <= LONG, pieces("fb", FRONT, BACK)).otherwise(none),
        F.when(size >= LONG, pieces("FB", LONG_PIECE, LONG_PIECE)).otherwise(none),
    )
    placed = words.select("word", "n", F.explode(keys).alias("block"))
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(size) / CHUNK_LETTERS)).cast("int")
    large = settled(placed.groupBy("block").agg(chunks.alias("_chunks")).where("_chunks > 1"))
    tiles = F.expr("""
        concat(transform(sequence(0, _chunks - 1), x -> struct(_own AS q, x AS x, true AS asks, x = _own AS known)),
               transform(filter(sequence(0, _chunks - 1), q -> q <> _own), q -> struct(q AS q, _own AS x, false AS asks, true AS known)))""")
    cut = placed.join(large, "block", "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    cut = cut.withColumn("_own", F.expr("CAST(pmod(xxhash64(word), _chunks) AS INT)"))
    dealt = cut.select("word", "n", "block", F.inline(tiles)).select("block", "q", "x", "word", "n", "asks", "known")

    def tables(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        for (block, _, _), tile in groupby(rows, key=lambda row: row[:3]):
            queries, known, counts = [], [], []
            for *_, word, n, asks, indexed in tile:
                if asks:
                    queries.append(word)
                if indexed:
                    known.append(word)
                    counts.append(n)
            held += near_in_tile(block[0], queries, known, counts)
            if len(held) > HELD_ROWS:
                yield tables(held)
                held = []
        if held:
            yield tables(held)

    # A number of its own, as a tile's work is far more than its bytes tell.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "block", "q", "x").sortWithinPartitions("block", "q", "x")
    found = dealt.mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("_best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.best").alias("best"))


def spelling_forms(docs: DataFrame, *, ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the table documents.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where 31 divides the crc32 of
    "<doc_id>:<run>", the run's letter at crc32 modulo its length is taken out first. Kept are words of at
    least 7 letters found at least twice. A word's form is its near word of largest n (ties: first in
    code-point order) if that n is at least ``ratio`` times its own; root is the end of the chain of forms.
    Null and empty texts have no words; a null doc_id counts as the empty id; repeated rows count each; texts
    and words of any length are taken whole; other columns of docs are ignored, whatever their names. A table
    without words gives an empty result. Runs jobs when called.
    """
    words = settled(vocabulary(docs))
    near = settled(near_words(words, chunk=chunk))
    forms = words.join(near, "word", "left")
    formed = F.col("best_n") >= F.col("n") * ratio
    forms = settled(forms.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"),
    ))
    # Counts grow at least tenfold along a chain, so doubling the step ends after a few rounds.
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = settled(roots.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if roots.where("_moved").isEmpty():
            break
        roots = roots.drop("_moved")
    out = forms.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT run, times, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda s: unicode(s)) AS points FROM runs
), hashed AS (
  SELECT run, times, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(points, lambda p:
           CASE WHEN p < 128 THEN [p::BIGINT] ELSE [192 + (p::BIGINT >> 6), 128 + (p::BIGINT & 63)] END)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cut AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS piece
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.piece = b.piece AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.piece = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.piece = b.word
), near AS (
  SELECT p.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(other, (-o.n, other)) AS best
  FROM pairs p JOIN words o ON p.other = o.word GROUP BY p.word
), forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)
"""
