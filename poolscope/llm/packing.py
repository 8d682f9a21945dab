"""Harmonic packing of token sequences.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths over 1/(k+1) and up to 1/k
of the capacity, and k of them fill a bin. Each task fills its own bins from a stream of documents,
holding one open bin a class, so nothing is shuffled and memory stays bounded. Documents are cut so
that nearly all pieces have a length that fills its class exactly (the capacity over a power of two);
only the last piece of a document may have another. Bins still open at a task's end are emptied and
their pieces packed first-fit, longest first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from poolscope.llm.common import by_bytes, documents, release, words_on_workers

CAPACITY = 2048
LEAST_TAIL = 64
BATCH_BYTES = 2_000_000
ENCODED_AT_ONCE = 8_192
SEGMENT_CHARS = 1_000_000
CACHED_PARTS = 250_000
CACHED_CHARS = 64

# White space as Unicode has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A byte-level pre-tokenizer never joins what these separate: the last blank of a run goes with the
#: word after it, the rest of the run is a part, and so is a run at the end.
_blanks = f"[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}](?=[^{_WS}])|[{_WS}]+"
_parts = re.compile(f" ?[^{_WS}]+|{_blanks}").findall
#: GPT-2's pattern, fixed in its library, also parts letters, digits and other signs. A word is cut between such runs while they
#: are of ASCII and Latin-1 letters; an apostrophe keeps the letters after it, and what holds any other character stays whole.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIGNS = "!-/:-@\\[-`{-~"
_known_next = f"(?![^ -~{_LETTERS}{_WS}])"
_runs = re.compile(
    f" ?[{_LETTERS}]++{_known_next}| ?[0-9]++{_known_next}"
    f"| ?[{_SIGNS}]++(?:(?<=')[{_LETTERS}]++)?+{_known_next}| ?[^{_WS}]+|{_blanks}"
).findall
_ends = re.compile(f"[^{_WS}](?= [^{_WS}])")

_models: dict[str, tuple] = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _model(path: str) -> tuple:
    """Tokenizer, pattern of special strings or None, what cuts a text into parts, and the ids of known parts as bytes."""
    if path not in _models:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        special = [t.content for t in model.get_added_tokens_decoder().values()]
        split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        rule = json.loads(model.to_str())["pre_tokenizer"] or {}
        gpt2 = rule.get("type") == "ByteLevel" and rule.get("use_regex")
        _models[path] = model, split, _runs if gpt2 else _parts, {}
    return _models[path]


def _segments(text: str) -> Iterator[str]:
    """A long text in parts, cut before a single blank between words."""
    start = 0
    while len(text) - start > SEGMENT_CHARS:
        cut = _ends.search(text, start + SEGMENT_CHARS)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, as the whole text's encoding has them."""
    model, split, cut, known = _model(path)
    parts = []
    for text in texts:
        own: list[str] = []
        for i, stretch in enumerate(split.split(text) if split else [text]):
            if i % 2:  # a special string
                own.append(stretch)
                continue
            for segment in _segments(stretch):
                own += cut(segment)
        parts.append(own)
    missing = list(set().union(*parts).difference(known))
    for i in range(0, len(missing), ENCODED_AT_ONCE):  # an encoding takes many times its ids
        some = missing[i : i + ENCODED_AT_ONCE]
        for part, found in zip(some, model.encode_batch_fast(some, add_special_tokens=False), strict=True):
            known[part] = b"".join([i.to_bytes(4, "little") for i in found.ids])
    out = [b"".join(map(known.__getitem__, own)) for own in parts]
    room = len(known) <= CACHED_PARTS
    for part in missing:
        if not room or len(part) > CACHED_CHARS:
            del known[part]
    return out


def cuts(length: int, capacity: int = CAPACITY, tail: int = LEAST_TAIL) -> list[int]:
    """Lengths of a document's pieces, in order: whole capacities, halves, quarters and so on, and a tail.

    A tail shorter than ``tail`` is left only where what whole capacities leave is shorter.
    """
    whole, rest = divmod(length, capacity)
    pieces, size = [capacity] * whole, capacity // 2
    while rest and size >= 2 * tail:
        if rest == size or rest - size >= tail:
            pieces.append(size)
            rest -= size
        else:
            size //= 2
    if rest:
        pieces.append(rest)
    return pieces


class Bins:
    """One worker's bins. ``add`` and ``close`` return the pieces of finished bins, placed."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}

    def _placed(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for piece in pieces:
            out.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, crc, doc_tokens)."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._placed(self.open.pop(k)) if len(held) == k else []

    def close(self) -> list[tuple]:
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        bins: list[list[tuple]] = []
        free: list[int] = []
        for piece in rest:
            at = next((i for i, room in enumerate(free) if room >= piece[2]), len(bins))
            if at == len(bins):
                bins.append([])
                free.append(self.capacity)
            bins[at].append(piece)
            free[at] -= piece[2]
        self.open.clear()
        return [x for pieces in bins for x in self._placed(pieces)]


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, each placed in a sequence of at most ``capacity`` tokens.

    A document is its text's ids and then ``end_id``; null or empty text is ``end_id`` alone. Each id is
    in exactly one piece; offsets in a sequence are gapless. sequence_id is the task's number times 2^32
    and a count, so a task run again gives the same rows. ``capacity`` is a power of two, at least 256. Repeated rows
    are packed each; a null doc_id stays null; an empty table gives an empty result.
    """
    words_on_workers(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = pa.schema([(n, pa.int64()) for n in names])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            done: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(texts, tokenizer), strict=True):
                ids += end
                start, tokens = 0, len(ids) // 4
                for length in cuts(tokens, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    done += bins.add((doc_id, start, length, crc, tokens))
                    start += length
            if done:
                yield table(done)
        if done := bins.close():
            yield table(done)
        release(*[known for *_, known in _models.values()])

    return documents(docs, "doc_id", "text").mapInArrow(fill, PIECES)
