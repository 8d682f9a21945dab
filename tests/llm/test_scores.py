"""Quality, toxicity, quality rules and the language model: plain versions and held-out results."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscope.llm import language_model, quality, recurrent, rules, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        own = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            own = [w.upper() + "!!" for w in own]
        if toxic:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["nasty", "vile", "awful"]))
        rows.append((i, " ".join(own) + ".\n", "en", f"s{i % 3}"))
        labels.append((i, int(not bad), int(toxic), "x"))
    rows += [(1000, None, None, None), (1001, "", "en", "s0"), (1002, "w " * 50_000, "en", "s1"), (None, "nasty vile", "en", None), (7, rows[7][1], "en", "s1")]
    labels += [(1000, None, None, "x"), (5555, 1, 1, "x"), (None, 1, 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("stats", F.lit(1))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, label string"), rows, labels


def test_quality_tells_held_out_documents(spark, corpus):
    docs, labels, rows, marks = corpus
    got = quality.quality_scores(docs, labels).collect()
    truth = {i: q for i, q, *_ in marks}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, *_ in rows if i is not None and fold(i, 3) == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    kept = [r["doc_id"] for r in good.collect()]
    assert sorted(kept, key=str) == sorted((r["doc_id"] for r in got if r["predicted"]), key=str)


def test_each_row_is_judged_by_its_own_text(spark, corpus):
    docs, labels, rows, _ = corpus
    bad, fine = rows[0][1], rows[1][1]
    more = spark.createDataFrame([(None, bad, "en", "s"), (None, fine, "en", "s"), (2, bad, "en", "s"), (5000, bad, "en", "s")], docs.select("doc_id", "text", "lang", "source").schema)
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    kept = quality.keep_good(both, labels).where("text IS NOT NULL").collect()
    assert all(r["text"] != bad for r in kept) and sum(r["doc_id"] is None and r["text"] == fine for r in kept) == 1
    assert any(r["doc_id"] == 2 for r in kept)
    assert quality.keep_good(both.limit(0), labels).count() == 0


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(k, 1 + k, (200, 4)) for k in (0, 1)]
    sums = {k: (200.0, x[k].sum(0), x[k].T @ x[k]) for k in (0, 1)}
    model = quality.Discriminant.fit(sums)
    cov = [np.cov(v.T, bias=True) for v in x]
    both, logs = (cov[0] + cov[1]) / 2, []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * both
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-4 * np.eye(4)
        d = x[1] - x[k].mean(0)
        logs.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    np.testing.assert_allclose(model.score(x[1]), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)
    alone = quality.Discriminant.fit({1: sums[1]})
    assert alone.score(x[1][:2]).tolist() == [201 / 202] * 2


def test_no_labels(spark, corpus):
    docs, labels, rows, _ = corpus
    none = labels.limit(0)
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0 and toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_toxicity_finds_held_out_documents(spark, corpus):
    docs, labels, rows, marks = corpus
    got = toxicity.toxicity_scores(docs, labels, k=5).collect()
    truth = {i: t for i, _, t, _ in marks}
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(got) == len(rows) and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    for r in got:
        assert all(fold(i, 3) != 1 for i in r["evidence"]) and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_scores_are_shares_of_toxic_documents(spark):
    """One neighbour's vote is 0.6 at most, though each document with the word is toxic."""
    rows = [(i, f"plain text {i % 7}" + " nasty" * (i % 4 == 1)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i, _ in rows], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity_scores(docs, labels, k=1).collect() if r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 1) for r in got)
    assert all(r["score"] > 0.9 for r in got if r["doc_id"] % 4 == 1)


def test_toxic_words_of_a_small_language_are_found(spark):
    """Four toxic training documents hold its word, beside a hundred with that of a large language."""
    taught, held = ([i for i in range(1500) if (fold(i, 3) == 1) == h] for h in (False, True))
    own = dict.fromkeys(taught[:100] + held[:50], " nasty") | dict.fromkeys(taught[100:104] + held[50:52], " malvado")
    docs = spark.createDataFrame([(i, f"plain text {i % 7}" + own.get(i, "")) for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in own)) for i in range(1500)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).where("held_out").collect()
    assert {r["doc_id"] for r in got if r["predicted"]} == {i for i in held if i in own}


def test_calibration_leaves_the_own_row_out(spark):
    rows = [(i, [0], [1], i % 2) for i in (0, 1)] + [(0, [0], [1], 0)]
    index = toxicity.BlockMaxIndex(rows, np.ones(1))
    taught = spark.createDataFrame(rows + [(9, [0], [1], 1)], "doc_id long, terms array<int>, counts array<int>, label int")
    bins = toxicity.vote_bins(taught, spark.sparkContext.broadcast(index), 3, 0.5).collect()
    # Of ids 0, 0 and 1: 0 sees 1 alone, 1 sees 0 twice, 9 sees all three.
    votes = {round(1 / (1 + math.exp(-r["x"])), 6): (r["n"], r["n1"]) for r in bins}
    assert votes == {0.75: (2, 0), round(0.5 / 3, 6): (1, 1), 0.375: (1, 1)}


def test_calibration_is_monotone():
    x = np.array([-2.0, 0.0, 2.0])
    a, b = toxicity.calibration(x, np.full(3, 1000.0), np.array([100.0, 600.0, 950.0]))
    np.testing.assert_allclose(1 / (1 + np.exp(-(a + b * x))), [0.1, 0.6, 0.95], atol=0.03)
    falling = toxicity.calibration(x, np.full(3, 100.0), np.array([90.0, 50.0, 10.0]))
    assert falling[1] == 0.0 and abs(falling[0]) < 0.01
    assert toxicity.calibration(np.zeros(0), np.zeros(0), np.zeros(0)) == (0.0, 1.0)
    assert toxicity.calibration(np.array([9.0]), np.array([5.0]), np.array([5.0]))[1] >= 0


def test_block_max_equals_brute_force():
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 5, 30)

    def vector():
        terms = sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist())
        return terms, rng.integers(1, 4, len(terms)).tolist()

    examples = [(i, *vector(), int(rng.integers(2))) for i in range(500)]
    index = toxicity.BlockMaxIndex(examples, idf, block=8)
    dense = np.zeros((500, 30))
    by_id = {e[0]: e for e in examples}
    for n, i in enumerate(index.ids):
        dense[n, by_id[i][1]] = toxicity.unit_vector(by_id[i][1], by_id[i][2], idf)
    for _ in range(100):
        terms, counts = vector()
        w = toxicity.unit_vector(terms, counts, idf)
        cosines = np.round(dense[:, terms] @ w, 9)
        want = np.lexsort((np.arange(500), -cosines))[:7]
        want = want[cosines[want] > 0]
        at, found = index.nearest([(terms, counts)], 7)[0]
        np.testing.assert_allclose(found, cosines[want], atol=2e-9)
        assert np.isclose(found, cosines[at], atol=2e-9).all()


def plain_repeated(own):
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    return len({j for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_text_counts():
    rng = random.Random(8)
    for _ in range(300):
        own = [rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(60))]
        assert rules.repeated_words(own) == plain_repeated(own)
    assert rules.text_counts("a #b\n\na #b\n \na #b |<>") == (7, 12, 6, 1, 0, 3)
    assert rules.text_counts("") == (0, 0, 0, 0, 0, 0)


def test_sketches_merge_and_hold_their_accuracy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 2, 3000), np.zeros(500)])
    rows = spark.createDataFrame([(int(i % 7), float(v)) for i, v in enumerate(values)], "part int, s double")
    parts = rules.sketches(rows, ["part"], ["s"]).groupBy("statistic", "bucket").agg(F.sum("n").alias("n"))
    shares = [0.1, 0.25, 0.5, 0.9, 1.0]
    got = rules.quantiles(parts, [], shares).first()
    ordered = np.sort(values)
    for i, q in enumerate(shares):
        assert got[f"q{i}"] == pytest.approx(ordered[math.ceil(q * len(values)) - 1], rel=0.0101)


def test_rules_adapt_to_their_group(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, " ".join(word(rng.choice([4, 5, 6])) for _ in range(80)), "en", "prose") for i in range(200)]
    rows += [(1000 + i, " ".join(word(4) + " |" for _ in range(40)), "en", "tables") for i in range(200)]
    rows += [(2000, " ".join(word(4) + " |" for _ in range(40)), "en", "prose"), (2001, " ".join(word(30) for _ in range(50)), "en", "prose")]
    rows += [(3000, None, None, None), (3001, "few words", "en", "prose"), (3002, "same eight words again and again and again " * 9, "en", "prose")]
    rows += [(4000, rows[0][1], None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("statistic", F.lit(1))
    got = {r["doc_id"]: r for r in rules.apply_rules(docs).collect()}
    assert {i for i, r in got.items() if r["base_failed"]} == {3000, 3001, 3002}
    assert {i for i, r in got.items() if not r["kept"]} == {2000, 2001, 3000, 3001, 3002}
    assert "symbols_per_word" in got[2000]["broken"] and got[2001]["broken"] == ["word_length"]
    assert rules.apply_rules(docs.limit(0)).count() == 0


def plain_kept(rows):
    """What apply_rules keeps, by (doc_id, text), from sketches in dictionaries."""
    gamma = (1 + rules.ACCURACY) / (1 - rules.ACCURACY)
    at = lambda x: -(1 << 20) if x <= 1e-9 else math.ceil(math.log(x) / math.log(gamma))
    value = lambda b: 0.0 if b == -(1 << 20) else 2 * gamma**b / (gamma + 1)
    judged = []
    for doc_id, text, lang, source in rows:
        own, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
        repeated = plain_repeated(own)
        if len(own) >= 20 and 100 * repeated <= 30 * len(own):
            symbols = sum(c in "#*$%&|<>" for c in text)
            judged.append((doc_id, text, lang, source, (sum(map(len, own)) / len(own), symbols / len(own), 1 - len(set(lines)) / len(lines), repeated / len(own))))
    kept = {(d, t) for d, t, *_ in judged}
    for k, (low, spreads, least) in enumerate([(True, 4, 1.0), (False, 4, 0.1), (False, 4, 0.5), (False, 4, 0.25)]):
        for d, t, lang, source, s in judged:
            everything, same_lang, same = (Counter(at(o[4][k]) for o in judged if all(o[i] == j[i] for i in fields))
                                           for j in [(d, t, lang, source)] for fields in [(), (2,), (2, 3)])
            for upper, lower in ((everything, same_lang), (same_lang, same)):
                rows_above = sum(upper.values())
                for b in list(upper):
                    lower[b] += upper[b] * rules.PRIOR_ROWS / rows_above
            total, upto, q = sum(same.values()), 0.0, {}
            for b in sorted(same):
                upto += same[b]
                for share in (0.25, 0.5, 0.75):
                    if share not in q and upto >= share * total * (1 - 1e-9):
                        q[share] = value(b)
            reach = max(spreads * (q[0.75] - q[0.25]), least)
            if s[k] > q[0.5] + reach or (low and s[k] < q[0.5] - reach):
                kept.discard((d, t))
    return kept


def test_rules_against_a_plain_version(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(140):
        lang, source = [("en", "a"), ("en", "b"), ("de", "a"), (None, None)][int(i % 9 > 3) + int(i % 9 > 6) + int(i % 9 > 7)]
        length = {"en": 4, "de": 9, None: 6}[lang]
        words = ["".join(rng.choice(list("abcdefgh"), max(1, int(rng.normal(length, 1))))) for _ in range(int(rng.integers(15, 80)))]
        words += ["#" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(0, 3)))]
        if i % 11 == 0:
            words += ["x" * 30] * int(rng.integers(5, 25))
        rows.append((i // 2, ("\n" if i % 5 else " ").join([" ".join(words)] * (1 + (i % 13 == 0))), lang, source))
    rows += [(1, None, "en", "a"), (2, "", "en", "a"), (3, "long " * 40_000, "de", "a"), (4, "ab cde fgh " * 3 + " ".join(map(str, range(90_000))), "en", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n_words": F.lit("clash"), "bucket": F.lit(1), "n": F.lit(1)})
    got = rules.apply_rules(docs).collect()
    key = lambda d, t: (d, len((t or "").split()), len("".join((t or "").split())))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in got) == Counter(key(d, t) for d, t, *_ in rows)
    want = {key(d, t) for d, t in plain_kept(rows)}
    assert {(r["doc_id"], r["n_words"], r["word_chars"]) for r in got if r["kept"]} == want
    assert 0 < len(want) < sum(not r["base_failed"] for r in got)


def test_one_more_row_moves_thresholds_little(spark):
    rows = [("en", "a", i, 5.0 + i % 3) for i in range(400)] + [("en", "b", i, 9.0 + i % 3 / 10) for i in range(50)]
    names = [r[0] for r in rules.RULES]
    table = lambda n: spark.createDataFrame([(lang, src, *[x] * 4) for lang, src, i, x in rows if src == "a" or i < n], ["lang", "source", *names])
    few, more = (rules.thresholds(table(n)).where("source = 'b'").first() for n in (49, 50))
    assert few["high_word_length"] == pytest.approx(more["high_word_length"], rel=0.05)


def test_gradients():
    shape, rng = recurrent.Shape(12, 4, 3), np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in recurrent.initial(shape, rng.integers(1, 50, 15).astype(float), hidden=5).items()}
    texts = [rng.integers(0, 15, n).astype(np.int32) for n in (7, 3, 9, 1, 5)]
    tokens, owner = recurrent.lanes(texts, 2)
    before, first = recurrent._inputs(tokens, owner, shape)
    run = lambda q: recurrent.gradients(q, shape, tokens, before, first, np.zeros((2, 5)))
    loss, n, g, _ = run(p)
    assert loss == pytest.approx(-recurrent.log_probabilities(p, shape, texts).sum(), rel=1e-5)
    for k in p:
        at = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert g[k][at] * n == pytest.approx((run(up)[0] - run(down)[0]) / 2e-2, rel=2e-2, abs=1e-3)


def test_state_is_carried_through_windows_and_cleared_between_documents(monkeypatch):
    shape, rng = recurrent.Shape(12, 4, 3), np.random.default_rng(3)
    p = recurrent.initial(shape, rng.integers(1, 50, 15).astype(float))
    p["wx"] *= 10
    texts = [rng.integers(0, 15, n).astype(np.int32) for n in (300, 7, 90, 1)]
    together = recurrent.log_probabilities(p, shape, texts)
    monkeypatch.setattr(recurrent, "SCORE_WINDOW", 7)
    alone = [recurrent.log_probabilities(p, shape, [t])[0] for t in texts]
    np.testing.assert_allclose(together, alone, rtol=1e-4)
    # A distribution over all next tokens sums to 1.
    every = [np.array([3, 14, k], np.int32) for k in range(15)]
    start = recurrent.log_probabilities(p, shape, [np.array([3, 14], np.int32)])[0]
    assert np.exp(recurrent.log_probabilities(p, shape, every) - start).sum() == pytest.approx(1, rel=1e-4)


def test_language_model_scores(spark, corpus, monkeypatch):
    docs, _, rows, _ = corpus
    rows = rows + [(2000, "unseen " * 3, "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("clash"))
    monkeypatch.setattr(language_model, "vocabulary", lambda c, f=language_model.vocabulary: f(c, 64, 100))
    got = language_model.log_likelihoods(docs, sample=50).collect()
    own = [(i, (t or "").encode().lower().split() + [b""]) for i, t, *_ in rows]
    count = Counter(w for i, x in own if i is not None and fold(i, 7) != 2 for w in x)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, len(x), sum(count[w] > 0 for w in x), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), 6)) for i, x in own)
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert have == want
    held = [r for r in got if r["held_out"] and r["n_tokens"] < 1000]
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, *_ in rows if i is not None and fold(i, 7) == 2}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.log_likelihoods(docs.limit(0)).count() == 0
    untaught = language_model.log_likelihoods(docs.where("doc_id is null")).first()
    assert (untaught["n_known"], untaught["train_tokens"], untaught["base_score"]) == (0, 0, 0.0)


def test_language_model_does_not_depend_on_how_rows_lie(spark, corpus, monkeypatch):
    monkeypatch.setattr(language_model, "PART_TOKENS", 3_000)
    docs, got = corpus[0].where("doc_id is not null").dropDuplicates(["doc_id"]), []
    for parts in (4, 13):
        scored = language_model.log_likelihoods(docs.repartition(parts), sample=50)
        got.append({r["doc_id"]: (r["score"], r["n_tokens"], r["n_known"]) for r in scored.collect()})
    assert got[0].keys() == got[1].keys()
    assert all(got[1][k] == (pytest.approx(v[0], rel=1e-4), *v[1:]) for k, v in got[0].items())


def test_words_and_numbers_of_texts():
    texts = ["  A b\u00a0c\x0b\tÄd ", None, "", "\n", "x", "b b q q q R"]
    flat, lengths = language_model.split(pa.array(texts, pa.string()))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in flat.to_pylist()] == [w for own in plain for w in own] and lengths.tolist() == list(map(len, plain))
    known = {b"": 0, b"b": 1, b"x": 2}
    v = language_model.Vocabulary(recurrent.Shape(3, 2, 48), pa.array(["", "b", "x"]), 0, np.ones(3), np.arange(3), 1.0, np.zeros(48))
    made = v.numbers(pa.array(texts, pa.string()))
    for i, own in enumerate(plain):
        at = slice(made.starts[i], made.starts[i] + made.lengths[i])
        assert made.place[at].tolist() == [known.get(w, -1) for w in [*own, b""]]
        assert made.number[at].tolist() == [known.get(w, 3 + language_model.rare_class(w)) for w in [*own, b""]]
        rest = slice(made.bounds[i], made.bounds[i + 1])
        assert dict(zip(made.others[rest].to_pylist(), made.times[rest].tolist(), strict=True)) == Counter(w.decode() for w in own if w not in known)


def test_start_is_fitted_from_a_small_settled_table(spark, corpus, monkeypatch, tmp_path):
    docs, plain = corpus[0].select("doc_id", "text"), language_model.train
    docs.repartition(5).write.parquet(str(tmp_path / "documents"))
    seen = []
    monkeypatch.setattr(language_model, "train", lambda d, *more: seen.append(d) or plain(d, *more))
    language_model.log_likelihoods(spark.read.parquet(str(tmp_path / "documents")), sample=20)
    first, second = seen
    assert first.count() >= 20 and first.rdd.getNumPartitions() == 1
    assert not any(str(tmp_path) in f for f in first.inputFiles()) and any(str(tmp_path) in f for f in second.inputFiles())
