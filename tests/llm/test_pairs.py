"""Near copies and search against brute force; the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscope.llm import ngram_join, search


def sets_of(texts):
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in own]


def plain_classes(rows):
    """class_id and n_links by row, from all pairs."""
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    found = [((-1 if doc is None else doc), min(least[find(i)], default=None) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)]
    return sorted(found, key=str)


def variants(rng, base, n, changes):
    """Copies of a text, each with some words replaced."""
    out = []
    for _ in range(n):
        own = base.split()
        for _ in range(changes):
            own[rng.randrange(len(own))] = f"n{rng.random()}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = text(40)
    texts = [None, "", " \n", "one two", "one two", "one  two\n", "one two three"]
    texts += variants(rng, text(300), 40, 3) + [text(120)] * 15
    for _ in range(12):
        texts += variants(rng, text(rng.choice([30, 100, 400])), rng.choice([2, 3, 5]), 1)
    texts += [passage + " " + text(100) for _ in range(40)] + [text(8000)] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[20]), (None, "alone in the world of words"), rows[3], (texts.index("one two"), texts[60])]


@pytest.mark.parametrize("chunk", [256, 8])
def test_classes_equal_all_pairs(spark, copies, chunk):
    docs = spark.createDataFrame(copies, "doc_id long, text string").withColumn("c", F.lit("clash")).withColumn("size", F.lit(1))
    got = ngram_join.near_copies(docs, recall=0.99999, chunk=chunk).collect()
    found = [(-1 if r["doc_id"] is None else r["doc_id"], r["class_id"], r["n_links"]) for r in got]
    assert sorted(found, key=str) == plain_classes(copies)


def test_recall_of_one_set_of_runs():
    """Of pairs at the threshold itself, as many meet as promised."""
    rng = np.random.default_rng(0)
    runs, met = ngram_join.runs_for(0.9, 3), 0
    for _ in range(400):
        every = rng.integers(0, 2**64, 300, dtype=np.uint64)
        a, b = np.sort(every[:270]), np.sort(every[30:])  # 240 of 300 in common
        met += bool(np.intersect1d(ngram_join.chosen_paths(a, runs, 3), ngram_join.chosen_paths(b, runs, 3)).size)
    assert met >= 0.9 * 400 - 12
    assert ngram_join.runs_for(0.999, 3) > runs and ngram_join.depth_for(10**10) > ngram_join.depth_for(1000) == 3


def test_one_of_each_class_stays(spark, copies):
    docs = spark.createDataFrame([(*r, 1) for r in copies], "doc_id long, text string, class_id int")
    out = ngram_join.keep_one(docs, recall=0.99999)
    assert out.columns == docs.columns
    # Each class once; a text without words once for each of its ids; the unique text without id.
    classes = {(i, c, t) for (i, c, _), t in zip(plain_classes(copies), [t for _, t in sorted(copies, key=lambda r: str(r[0]))], strict=False)}
    want = {i for i, c, _ in plain_classes(copies) if i == c}
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(classes) > len(want) and len(rows) == len(set(rows))
    kept = [i for i, _ in rows]
    assert {i for i in kept if i is not None} == want and kept.count(None) == 1
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_a_unique_text_stays_though_its_id_also_names_a_copy(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(2, text("a")), (9, text("a")), (9, text("b")), (9, text("b")), (4, text("c")), (None, text("a"))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, text_hash int")
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_texts_that_share_an_id_all_stay(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(9, text("a")), (9, text("b")), (9, text("c")), (3, text("d")), (9, None), (4, ""), (None, text("e")), (None, text("e")), (8, text("e") + " x")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([*rows[:6], rows[8]], key=str)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["v"]: r["label"] for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def plain_search(rows, queries, k):
    counts = [Counter((t or "").encode().lower().split()) for _, t in rows]
    lengths = [sum(c.values()) for c in counts]
    mean, df = sum(lengths) / max(1, len(rows)), Counter(w for c in counts for w in c)
    out = []
    for q, text in queries:
        found = []
        for (doc, _), c, n in zip(rows, counts, lengths, strict=True):
            s = sum(times * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean))
                    for w, times in Counter((text or "").encode().lower().split()).items() if c[w])
            if s > 0:
                found.append((-round(s, 6), -1 if doc is None else doc))
        out += [(q, rank + 1, doc, -s) for rank, (s, doc) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("floor", [False, True])
def test_scores_that_round_alike_go_to_the_smaller_id(floor):
    """Id 5 has the lower score by 1e-8, and the same to 6 places."""
    head = np.array([1], np.uint64)
    side = search.Side.build([0], [np.array([1])], [np.array([1.0])], head)
    find = lambda ids, own, least: search.search_shard(side, search.Shard.build(ids, own), head, 1e8, 1, np.array([least]))[0]
    high, low = Counter({1: 1}), Counter({1: 1, 2: 1})
    if floor:
        first = find([10], [high], -1.0)
        rest = find([5], [low], first[1].min())
        ids, scores = np.r_[first[0], rest[0]], np.r_[first[1], rest[1]]
    else:
        ids, scores = find([10, 5], [high, low], -1.0)
    assert search._best(ids, scores, 1)[0].tolist() == [5]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    rng = random.Random(4)
    if small:  # shards and blocks of a few documents, a few frequent terms
        for name, n in (("SHARD_DOCS", 40), ("BLOCK", 4), ("HEAD_TERMS", 10), ("SIDE", 7), ("EXPANDED", 500)):
            monkeypatch.setattr(search, name, n)
    word = lambda: "W" + str(int(rng.paretovariate(0.7)) % 500)
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 30, 60])))) for i in range(150)]
    rows += [(500, None), (None, "W1 w2 w3"), (3, rows[3][1]), (7, "w1 " * 5000), (501, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(2)
    queries = [(i, t) for i, t in rows if i is not None and i % 20 == 0] + [(901, None), (902, "nowhere"), (903, "w1 w1 W2")]
    got = search.search(docs, spark.createDataFrame(queries, "query_id long, text string"), k=4, query_postings=100).collect()
    have = sorted((r["query_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
    want = sorted(plain_search(rows, queries, 4))
    assert [x[:3] for x in have] == [x[:3] for x in want] and np.allclose([x[3] for x in have], [x[3] for x in want], atol=2e-6)
    assert search.search(docs.limit(0), docs.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_terms_of_many_queries_and_documents_are_not_paired(monkeypatch):
    """300 terms that all of 64 queries and 64 documents share were 1.2 million pairs of postings."""
    made, ranges = [], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda start, length: made.append(int(np.sum(length))) or ranges(start, length))
    terms, none = np.arange(1, 301), np.zeros(0, np.uint64)
    side = search.Side.build(list(range(64)), [terms] * 64, [terms / (i + 1) for i in range(64)], none)
    shard = search.Shard.build(list(range(64)), [Counter({int(t): 1 + (t * d) % 5 for t in terms}) for d in range(64)])
    found = search.search_shard(side, shard, none, 700.0, 3, np.full(64, -1.0))
    assert sum(made) < 300 * 64 * 4
    plain = lambda d: sum(t * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * shard.lengths[d] / 700)) for t in terms for c in [1 + (t * shard.ids[d]) % 5])
    want = np.sort([plain(d) for d in range(64)])[::-1][:3]
    for i, (ids, scores) in enumerate(found):
        assert len(ids) < 64 and np.allclose(np.sort(scores)[::-1][:3], want / (i + 1), rtol=1e-12)


def test_pieces_of_a_shard_find_what_the_shard_does(monkeypatch):
    rng = np.random.default_rng(3)
    own = [Counter(rng.zipf(1.3, 40).clip(max=400).tolist()) for _ in range(100)]
    shard = search.Shard.build(list(range(100)), own)
    none, k = np.zeros(0, np.uint64), 5
    monkeypatch.setattr(search, "HEAD_TERMS", 20)
    asked = [np.array(sorted(c)) for c in own[:30]]
    side = search.Side.build(list(range(30)), asked, [1 + 1 / t for t in asked], none)
    whole = [search._best(*x, k) for x in search.search_shard(side, shard, none, 40.0, k, np.full(30, -1.0))]
    best = search.Best(30, k)
    for piece in shard.pieces(side.terms, 16):
        at = search._places(piece.terms, np.arange(len(side.terms)))
        best.add(*search._match(side, piece, at, piece.contributions(40.0), none, k, best.floor))
    best.merge()
    for i, (ids, scores) in enumerate(whole):
        mine = best.query == i
        assert best.ids[mine].tolist() == ids.tolist() and np.allclose(best.scores[mine], scores, rtol=1e-12)


def test_words_are_those_of_python():
    texts = ["  a  B\tc\n\x0b x\x0cy\r\n", None, "", " ", "É é ÀB \x1cq\x85w İ", "the The THE", " lead", "trail ", "a\x00b A\x00B a\x00c"]
    got = search.term_frequencies(pa.array(texts, pa.string()))
    assert [sorted(times.tolist()) for _, times in got] == [sorted(Counter((t or "").encode().lower().split()).values()) for t in texts]
    number = {}
    for (terms, times), text in zip(got, texts, strict=True):
        want = Counter((text or "").encode().lower().split())
        assert len(set(terms.tolist())) == len(want)
        if len(want) == 1:
            assert number.setdefault(next(iter(want)), terms[0]) == terms[0]


def test_shards_hold_like_documents_longest_first(spark):
    """Languages and lengths shared shards before, and no shard could be left out."""
    rng = random.Random(1)
    text = lambda i: " ".join(["ab"[i % 2] + str(int(rng.paretovariate(0.6)) % 300) for _ in range(rng.randint(20, 300))])
    docs = spark.createDataFrame([(i, text(i)) for i in range(160)], "doc_id long, text string").coalesce(1)
    rows = search.build_index(docs).collect()
    ids, lengths = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("ids", "lengths"))
    assert len(rows) == 2 and all(len(set((x % 2).tolist())) == 1 for x in ids)
    assert sorted(np.concatenate(ids).tolist()) == list(range(160))
    assert all((np.diff(n) <= 0).all() for n in lengths)


def test_queries_leave_out_what_cannot_reach_their_floors(monkeypatch):
    """Rare terms were paired whatever the floor: 2,400 pairs and their 1,200 postings."""
    made, ranges = [], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda start, length: made.append(int(np.sum(length))) or ranges(start, length))
    rng, none = np.random.default_rng(2), np.zeros(0, np.uint64)
    held = lambda: [np.flatnonzero(row) + 1 for row in (rng.random((600, 64)).argsort(1).argsort(1) < 2).T]
    asked, own = held(), [Counter(t.tolist()) for t in held()]
    side = search.Side.build(list(range(64)), asked, [np.ones(len(t)) for t in asked], none)
    shard = search.Shard.build(list(range(64)), own)
    least = np.array([2.2 * len(t) + 1 for t in asked])
    assert all(len(ids) == 0 for ids, _ in search.search_shard(side, shard, none, 20.0, 3, least))
    assert sum(made) <= 1200
    least[5] = -1  # one that has no floor is searched alone
    found = search.search_shard(side, shard, none, 20.0, 3, least)
    scores = [sum(1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(c) / 20)) for t in asked[5].tolist() if t in c) for c in own]
    assert sorted(np.round(found[5][1], 9).tolist())[-3:] == sorted(np.round(scores, 9).tolist())[-3:]
    assert all(len(ids) == 0 for i, (ids, _) in enumerate(found) if i != 5)


def test_queries_that_share_an_id_are_one_of_all_their_words(spark):
    """A term of both rows counted once where it was a column of the matrix, twice where it was paired."""
    rng = random.Random(6)
    word = lambda: "w" + str(int(rng.paretovariate(0.8)) % 200)
    rows = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    queries = [(1, rows[1][1]), (1, rows[1][1]), (2, rows[2][1]), (2, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = search.search(docs, spark.createDataFrame(queries, "query_id long, text string"), k=5).collect()
    want = plain_search(rows, [(1, " ".join([rows[1][1]] * 2)), (2, f"{rows[2][1]} {rows[3][1]}")], 5)
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == sorted(x[:3] for x in want)
    assert np.allclose(sorted(r["score"] for r in got), sorted(x[3] for x in want), atol=2e-6)
