"""What a Python worker holds at a time is bounded."""

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from poolscope.llm import common, packing, search


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Rows of a megabyte came in one batch of 64 MB before."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(limit)
    largest = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        spark.conf.unset(limit)
        common.words_on_workers(spark)
        rows = spark.range(40, numPartitions=1).selectExpr("repeat('x', 1000000) AS text")
        assert max(r["n"] for r in rows.mapInArrow(largest, "n long").collect()) < common.ARROW_BATCH + 2_000_000
        spark.conf.set(limit, "123456")
        common.words_on_workers(spark)
        assert spark.conf.get(limit).rstrip("b") == "123456"
    finally:
        spark.conf.set(limit, was)


def test_a_block_of_queries_holds_no_matrix():
    """256 queries of one frequent term each took 0.8 MB, a block's some 40 such matrices."""
    head = np.arange(1, search.HEAD_TERMS + 1, dtype=np.uint64)
    n = search.SIDE
    side = search.Side.build(list(range(n)), [np.array([1 + i % 50]) for i in range(n)], [np.array([float(i)]) for i in range(n)], head)
    assert sum(x.nbytes for x in vars(side).values()) < 24 * n
    full = side.matrix(len(head))
    assert full.shape == (n, len(head)) and all(full[i, i % 50] == i for i in range(n)) and full.sum() == n * (n - 1) / 2


@pytest.mark.parametrize("at_once", [3, 10_000])
def test_parts_are_encoded_few_at_once(monkeypatch, at_once):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, *rest = packing._model(path)
    seen = []

    class Counted:
        def encode_batch_fast(self, parts, **options):
            seen.append(len(parts))
            return model.encode_batch_fast(parts, **options)

    monkeypatch.setitem(packing._models, path, (Counted(), *rest[:-1], {}))
    monkeypatch.setattr(packing, "ENCODED_AT_ONCE", at_once)
    texts = ["Eins zwei drei, four five! 6 sieben\n acht", "zwei", ""]
    got = packing.encode_texts(texts, path)
    assert max(seen) <= at_once and (at_once > 3) == (len(seen) == 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [model.encode(t, add_special_tokens=False).ids for t in texts]
