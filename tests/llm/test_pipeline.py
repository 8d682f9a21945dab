"""The stages in a row, each held against what it should have done to its own input."""

import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, {"start": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.toPandas()
    start, kept = rows["start"], rows["quality"]
    assert 0.6 * len(start) < len(kept) < len(start)
    text = start.set_index("doc_id")["text"]
    assert (kept.set_index("doc_id")["text"] == text[kept["doc_id"]]).all()
    lines = rows["line_dedup"]
    assert set(lines["doc_id"]) == set(kept["doc_id"]) and (lines["n_chars"] == lines["text"].str.len()).all()
    once = rows["ngram_join"]
    assert once["doc_id"].is_unique and set(once["doc_id"]) <= set(lines["doc_id"]) and once["text"].nunique() == len(once)
    mixed = rows["mixing"]
    assert set(mixed["doc_id"]) <= set(once["doc_id"]) and mixed.groupby("doc_id").size().max() <= 3
    packed = rows["packing"]
    assert set(packed["doc_id"]) == set(mixed["doc_id"])
    assert len(corpus_pipeline.run(spark, FOLDER).toPandas()) == len(packed)
