"""Token counts and packing, against the library's encoding of whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from poolscope.llm import packing, token_counts

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "a", "B", "é", "'s", "12", "!", "<|endoftext|>", "\t", "\xa0", "́", "\x1c", " ", "word", "Ünd.", "\x85"]
    odd = ["", " ", " \n", "\n", "<|endoftext|>", "a\n <|endoftext|>\n y", "<|startoftext|>a", "ab" * 5000, "x y " * 3000, "don't I'll", "a\r\n b\r\n"]
    return odd + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_counts_equal_whole_texts(spark, texts, monkeypatch):
    whole = Tokenizer.from_file(WORDS)
    want = [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, WORDS) == want
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 50)
    monkeypatch.setattr(token_counts, "CACHED_PARTS", 5)
    monkeypatch.setattr(token_counts, "_lengths", {})
    assert token_counts.count_texts(texts, WORDS) == want
    assert ["".join(token_counts.segments(t, 7)) for t in texts] == texts


def test_counts_of_a_table(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "a b"), (5, "a b"), (None, "x"), (9, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(docs, WORDS, limit=20).collect()
    whole = Tokenizer.from_file(WORDS)
    want = [(i, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


def test_ids_equal_whole_texts(texts, monkeypatch):
    whole = Tokenizer.from_file(BYTES)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(texts, BYTES)] == want
    rng = random.Random(2)
    signs = [*"abZ09'`.,! \n\t\r\x85\xa0\x1c\x00\x7fé×÷ßÿ²½Ⅷ一\u200bªºµ_-|#\u0301", "'s", "'ll", "'RE", " '", "🙂", "<|endoftext|>"]
    mixed = ["".join(rng.choices(signs, k=rng.randrange(1, 25))) for _ in range(20_000)]
    whole_ids = [e.ids for e in whole.encode_batch(mixed, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(mixed, BYTES)] == whole_ids
    monkeypatch.setattr(packing, "SEGMENT_CHARS", 9)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(texts, BYTES)] == want


def test_cuts():
    for n in range(1, 9000):
        own = packing.cuts(n)
        assert sum(own) == n and min(own) >= min(n % 2048 or 2048, packing.LEAST_TAIL) and max(own) <= 2048
        assert all(p & (p - 1) == 0 for p in own[:-1])


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, "")] * 3 + [(None, "a b")],
    [(i, "some words here " * (i % 50) + "é" * (i % 7)) for i in range(700)] + [(9999, "long text, cut often. " * 20_000)],
])
def test_every_id_is_packed_once(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int")
    got = packing.pack(docs, BYTES).collect()
    whole, texts = Tokenizer.from_file(BYTES), defaultdict(list)
    for i, t in rows:
        texts[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = texts[i][0]  # rows that share an id are alike here
        assert sum(r["length"] for r in own) == sum(map(len, texts[i]))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["doc_tokens"] == len(ids) and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    if len(rows) > 100:
        used = sum(r["length"] for r in got)
        assert used > 0.94 * 2048 * len(sequences)  # each of eight tasks leaves a bin unfilled
