"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

A text is cut at blanks and line ends, where a tokenizer that drops white space cuts anyway; each batch
encodes the distinct parts it hasn't met yet and adds up lengths. So a long text is never encoded at
once, a batch is bounded by its bytes, and no token ids leave the worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import by_bytes, documents, release, words_on_workers

BATCH_BYTES = 4_000_000
SEGMENT_CHARS = 1_000_000
CACHED_PARTS = 400_000
CACHED_CHARS = 64

_lengths: dict[str, dict[str, int]] = {}
_loaded: dict[str, object] = {}


def _encoder(path: str):
    """Texts to token counts, by the file's library; loaded once in a worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def segments(text: str, most: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in parts of some ``most`` characters that end before a blank."""
    start = 0
    while len(text) - start > most:
        cut = text.find(" ", start + most)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Token counts of texts; parts between blanks are encoded once and remembered."""
    encode, known = _encoder(path), _lengths.setdefault(path, {})
    sums = [0] * len(texts)
    batch: list[tuple[int, list[str]]] = []

    def add_up() -> None:
        missing = list(set().union(*(parts for _, parts in batch)).difference(known))
        known.update(zip(missing, encode(missing), strict=True))
        for i, parts in batch:
            sums[i] += sum(map(known.__getitem__, parts))
        room = len(known) <= CACHED_PARTS
        for part in missing:
            if not room or len(part) > CACHED_CHARS:
                del known[part]
        batch.clear()

    held = 0
    for i, text in enumerate(texts):
        for segment in segments(text):
            batch.append((i, segment.replace("\n", " ").split(" ")))
            held += len(segment)
            if held > BATCH_BYTES:
                add_up()
                held = 0
    add_up()
    return sums


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents.

    ``tokenizer``: path of a tokenizers .json whose pre-tokenizer drops white space (parts between
    blanks are then encoded as in the whole text). Special strings are read as the library does by
    default; nothing is added, cut or padded. Null or empty text: 0 bytes, 0 tokens. Repeated rows are
    counted each; a null doc_id stays null; an empty table gives an empty result.
    """
    words_on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = pc.fill_null(batch.column("text"), "")
            tokens = count_texts(texts.to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )
        release(_lengths)

    counted = documents(docs, "doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
