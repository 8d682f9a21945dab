"""Spelling variants, exact copies and token alignment, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from poolscope.llm import alignment, exact_dedup, spelling

DOCS = "doc_id long, text string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Spelling ----------------------------------------------------------------------------------------

def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def typos(rng, word):
    at, letter = rng.randrange(len(word) + 1), rng.choice("abeé")
    return rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


@pytest.fixture(scope="module")
def written():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeéßB") for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    stems += ["x" * 62 + "abc", "abcdefg" * 9, "q" * 30 + "abcd" * 9, "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    weights = [1000 / (k + 1) ** 2 for k in range(len(stems))]
    rows = [(0, None), (1, ""), (2, "--- 12 Ābcdefghł ")]
    for i in range(3, 200):
        own = rng.choices(stems, weights, k=60)
        own = [typos(rng, w) if rng.random() < 0.2 else w for w in own for _ in range(rng.choice([1, 1, 2]))]
        rows.append((i, rng.choice([" ", ", ", "\n", "Ж"]).join(own)))
    long = ["x" * 62 + "abc", "x" * 62 + "abd", "x" * 61 + "abc"]
    rows += [(600 + i, " ".join(long)) for i in range(3)]
    return rows + [(None, "nothing nothing"), (3, rows[3][1]), (500, "averyveryverylongdocument " * 5000)]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_forms_equal_plain_version(spark, written, chunk):
    want = plain_forms(plain_words(written))
    got = spelling.spelling_forms(spark.createDataFrame(written, DOCS).repartition(5), chunk=chunk)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert any(r[1] and r[1] != r[2] for r in found) and any(len(r[0]) >= 64 and r[4] for r in found)


def test_near_words_around_the_border_of_long_words(spark):
    base = "".join(chr(97 + i * 7 % 26) for i in range(66))
    words = {base[:n]: n for n in (62, 63, 64, 65, 66)}
    words |= {"z" + base[1:n]: 100 + n for n in (63, 64, 65)} | {base[: n - 1] + "ÿ": 200 + n for n in (63, 64, 65)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(frame).collect()}
    for w in words:
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda x: (-words[x], x))
        assert got[w] == (len(near), words[best], best)


def test_chains_end_at_the_last_form(spark):
    words = {"aaaaaaaa": 10**6, "aaaaaaab": 10**5, "aaaaaabb": 10**4, "aaaaabbb": 10**3, "aaaabbbb": 100, "aaabbbbb": 10}
    text = " ".join(w for w, n in words.items() for _ in range(n // 10))
    got = {r["word"]: r["root"] for r in spelling.spelling_forms(spark.createDataFrame([(6, text)], DOCS)).collect()}
    known = plain_words([(6, text)])
    assert {r[0]: r[2] for r in plain_forms(known)} == got and len(known) >= 4


def test_spelling_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_forms(empty).count() == 0
    clash = spark.createDataFrame([(1, "letters letters")], DOCS).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("block", F.lit(2))
    assert [tuple(r) for r in spelling.spelling_forms(clash).collect()] == [("letters", None, "letters", 2, 0, None)]


# Exact copies ------------------------------------------------------------------------------------

def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((i, t or ""))
    out = []
    for content, own in groups.items():
        digest = hashlib.sha256(content.encode()).hexdigest()
        own.sort(key=lambda x: (-len(x[1]), x[0] is None, x[0]))
        out += [(i, own[0][0], len(own), k == 0, digest) for k, (i, _) in enumerate(own)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n\t\x0b\x0c\r"), (3, "a b"), (4, "ab"), (None, "ab "), (None, "a b"), (5, "y" * 70_000), (6, "y " * 70_000)]
    rows += [(i, f"text {i % 30} é中" + " " * rng.randrange(3)) for i in range(10, 120)]
    rows += [(i, rng.choice(["hot text", "hot  text", "hot\ntext"])) for i in range(200, 320)]
    rows += [(-7, "below zero"), (8, "below zero"), (9, "again"), (9, "again"), (9, "again"), (700, "hot text"), (700, "hot text")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"heavy": 4}, {"digest": lambda sha: F.substring(sha, 1, 1)},
                                     {"digest": lambda sha: F.substring(sha, 1, 0), "heavy": 2}])
def test_copies_equal_plain_version(spark, copied, options):
    docs = spark.createDataFrame(copied, DOCS).repartition(7)
    got = exact_dedup.exact_copies(docs, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_copies(copied)


def test_copies_of_odd_tables(spark):
    assert exact_dedup.exact_copies(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a", 5), (2, "a ", 6)], f"{DOCS}, _content long").withColumn("kept", F.lit("x")).withColumn("_order", F.lit(1))
    got = exact_dedup.exact_copies(clash, carry=["text", "_content"])
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["text"], r["_content"]) for r in got.collect()) == [(1, 2, False, "a", 5), (2, 2, True, "a ", 6)]


# Alignment ---------------------------------------------------------------------------------------

def plain_alignment(rows):
    """By whole-text encodings and a walk over both sides' byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}

    def ranges(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found, counts = [], Counter()
    for i, text in rows:
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        bytes_a = [bytes(byte[c] for c in left.id_to_token(x)) for x in a]
        names = [right.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(n[3:5], 16)]) if right.is_byte(x) else n.replace("▁", " ").encode() for x, n in zip(b, names, strict=True)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((i, None))
            continue
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        links, low = [], 0
        for x, (start, end) in zip(a, ra, strict=True):
            while rb[low][1] <= start:
                low += 1
            at = low
            while at < len(rb) and rb[at][0] < end:
                links.append((x, b[at]))
                at += 1
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, k, m = [], 0, 0
        for end in ends:
            p, q = k, m
            while k < len(ra) and ra[k][1] <= end:
                k += 1
            while m < len(rb) and rb[m][1] <= end:
                m += 1
            groups.append(",".join(map(str, a[p:k])) + "|" + ",".join(map(str, b[q:m])))
        counts.update(links)
        found.append((i, (len(a), len(b), len(groups), links, ";".join(groups))))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, own in found:
        if own is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = own
        best, total = sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((i, n_a, n_b, n_groups, len(links), best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(13)
    parts = ["the", "Wort", "naïve", "日本語", "x1y2", "  ", "\n", "\t", " ", " ", "\U0001F600", "é", "<0x0A>", "<s>", "<|endoftext|>",
             "don't", "...", "\x00", " ", "1234567", "antidisestablishment", "ﬁ", "_", " \n ", "\r\n"]
    rows = [(0, None), (1, ""), (2, " "), (3, "  "), (4, "a "), (5, "a▁b"), (6, "▁"), (7, "x" * 5000), (8, "word " * 30_000), (None, "the end"), (9, "the end"), (9, "the end")]
    return rows + [(20 + i, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(150)]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_alignment_equals_plain_version(spark, spoken, frequent, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 4000)
    got = alignment.align_tokens(spark.createDataFrame(spoken, DOCS).repartition(4), A, B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_alignment(spoken)


def test_alignment_of_odd_tables(spark):
    assert alignment.align_tokens(spark.createDataFrame([], DOCS), A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], DOCS).withColumn("pairs", F.lit(1)).withColumn("row", F.lit("x"))
    assert sorted(tuple(r) for r in alignment.align_tokens(blank, A, B).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_offsets_key_the_document_in_both_directions():
    """Tokens of three documents, one of them without any: no link leaves its document, and groups end with it."""
    from poolscope.llm.alignment import Aligned, covering
    assert covering(np.array([0, 2, 5]), np.array([0, 3, 5])).tolist() == [0, 0, 2]
    sizes = np.array([1, 2, 3])
    none = np.zeros(0, np.int32)
    found = Aligned([np.array([1, 2], np.int32), none, np.array([0, 1], np.int32)], [np.array([2, 1], np.int32), none, np.array([2], np.int32)], sizes, sizes)
    assert sorted(zip(found.link_a.tolist(), found.link_b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]
    assert found.groups().tolist() == [1, 0, 1]
