"""The quality rules judge long texts tightly and short ones loosely, in the query and the pipeline alike."""

import os

import pytest

from epochweave.llm import quality


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no labelled table")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").distinct()
    kept = {r["doc_id"] for r in quality.keep_good(docs).select("doc_id").collect()}
    rows = quality.judge(docs, ["doc_id"], write=True).where("not base_failed and n_words >= 100").join(labels, "doc_id").collect()
    junk, clean = ([r for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(junk) > 20 and len(clean) > 200
    assert sum(r["doc_id"] in kept for r in junk) == 0
    assert sum(r["doc_id"] in kept for r in clean) >= 0.99 * len(clean)
    assert all(r["kept"] == (r["doc_id"] in kept) for r in rows)
