"""Line dedup and mixing."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from poolscope.llm import line_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def plain_dedup(rows):
    lines = {i: (t or "").split("\n") for i, t in rows}
    docs = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            if len(key(x)) >= 40:
                docs[key(x)].add(i)
    out = {}
    for i, own in lines.items():
        kept = [x for x in own if len(key(x)) < 40 or len(docs[key(x)]) < 5 or max(docs[key(x)]) == i]
        out[i] = len(own), len(own) - len(kept), "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(5)
    shared = [f"Shared line {i} " + "word " * 8 for i in range(6)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x" * 60_000 + "\n" + shared[0])]
    for i in range(4, 60):
        own = [rng.choice(shared) if rng.random() < 0.4 else f"own {rng.random()} " + "w" * rng.randrange(60) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice(["", "\n", " \t"]).join(["", ""]) + "\n".join(x.upper() if rng.random() < 0.2 else x + " \t" for x in own)))
    rows += [(100 + i, "ÄÖ short\n" + shared[5] + "\n" + shared[5]) for i in range(5)]
    return rows


def test_lines_equal_plain_version(spark, lined):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in lined])
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs, fanout=2).collect()}
    assert got == plain_dedup(lined)


def test_heavy_keys_and_merges_give_the_same(spark, lined, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 3)
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in lined])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, batches=7, fanout=3).collect()}
    assert got == {i: x[2] for i, x in plain_dedup(lined).items()}


def test_unseen_lines_of_a_batch(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    one = frame(spark, [(1, "a" * 50 + "\n" + "b" * 50, "", "", 0)])
    two = frame(spark, [(2, "b" * 50 + "\n" + "c" * 50, "", "", 0)])
    hashes = [line_dedup.line_hashes(x) for x in (one, two)]
    assert runs.unseen(hashes[0]).count() == 2
    runs.add(hashes[0])
    assert [r["at"] for r in runs.unseen(hashes[1]).collect()] == [1]
    runs.add(hashes[1])
    assert {r["n_docs"] for r in runs.entries().collect()} == {1, 2} and [len(x) for x in runs.levels] == [0, 1]


def test_lines_of_odd_tables(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    line = "z" * 41
    rows = [(7, line, "en", "s", 1)] * 2 + [(None, line, "en", "s", 1)] + [(i, line, "en", "s", 1) for i in range(4)]
    docs = frame(spark, rows).withColumn("_gone", F.lit("x")).withColumn("n_lines", F.lit("clash")).withColumn("row", F.lit(3))
    out = line_dedup.dedup_lines(docs)
    assert sorted(out.columns) == sorted([*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "_gone", "row", "n_lines", "n_dropped"])
    found = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert sorted(found) == [(i, "", 1, 1) for i in range(-1, 4)] + [(7, line, 1, 0)] * 2


def plain_taken(rows):
    """rows: (doc_id, text, source); the contract with resharing in rounds."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    of = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free, left = {}, list(sources), sum(of.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * of[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * of[s]
        left -= sum(3 * of[s] for s in over)
        free = [s for s in free if s not in over]
    taken = {}
    for s in sources:
        quota, own = int(target[s] + 0.5), [i for i, _, x in rows if x == s]
        passes, rest = divmod(quota, of[s]) if of[s] else (0, 0)
        for i in sorted(own, key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i)):
            part = min(size[i], rest)
            taken[i], rest = passes * size[i] + part, rest - part
    return {i: (size[i], of[s], target[s], taken[i]) for i, _, s in rows}


def test_mix_equals_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(300)]
    rows += [(1000, None, "tiny"), (1001, "one two", "tiny"), (1002, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_taken(rows)
    for shards in (1, 8):
        got = {r["doc_id"]: tuple(r)[1:] for r in mixing.taken(docs, shards=shards).collect()}
        assert {i: (a, b, d) for i, (a, b, _, d) in got.items()} == {i: (a, b, d) for i, (a, b, _, d) in want.items()}
        assert all(abs(got[i][2] - want[i][2]) < 1e-6 for i in want)
        assert all(t <= 3 * n for n, _, _, t in got.values())


def test_tree_splits_quotas_exactly(spark):
    quotas = {"a": 1000, "b": 37, "c": 3, "d": 0, "e": 2500}
    rows = spark.createDataFrame(list(quotas.items()), "_key string, n_copies long")
    drawn = []
    for seed in range(12):
        found = {r["_key"]: list(r["_shares"]) for r in mixing.shard_quotas(rows, 8, seed).collect()}
        assert {k: sum(v) for k, v in found.items()} == quotas and all(min(v) >= 0 for v in found.values())
        sizes = [sum(v[i] for v in found.values()) for i in range(8)]
        assert max(sizes) - min(sizes) <= 3
        drawn += found["a"]
    # Multivariate hypergeometric: the mean is the quota's eighth, the deviation that of draws without replacement.
    mean = sum(drawn) / len(drawn)
    deviation = (sum((x - mean) ** 2 for x in drawn) / len(drawn)) ** 0.5
    total = sum(quotas.values())
    expected = (total / 8 * (1000 / total) * (1 - 1000 / total) * (7 / 8)) ** 0.5
    assert mean == 125 and 0.7 * expected < deviation < 1.3 * expected


def test_mix_draws_whole_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "s" + str(i % 3), i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long").withColumn("_size", F.lit("x")).withColumn("words", F.lit(1))
    out = mixing.mix(docs, shards=4)
    assert out.columns == docs.columns and out.where("shard <> doc_id").count() == 0
    again = mixing.mix(docs, shards=4)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.taken(docs).collect()}
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(times.get(i, 0) * n - t) <= n / 2 for i, (t, n) in taken.items())


def test_pieces_of_shards_are_even(spark):
    rows = [(i, "w " * 10, f"s{i % 5}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, shards=4, piece_words=3000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == out.rdd.getNumPartitions() >= 12 and max(sizes) < 1.5 * min(sizes)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(docs, shards=4).collect()))


def test_mix_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, "", "a")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in mixing.taken(blank).collect()] == [(0, 0, 0.0, 0)] * 2
    twice = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.taken(twice).collect()) == [(None, 2, 4, 4.0, 2)] * 2
