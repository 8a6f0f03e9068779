"""The last stage of the pipeline makes the packed corpus itself."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402


def test_packed_stage_returns_ids(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words of text"), (2, "more words")], "doc_id bigint, text string")
    rows = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert len(rows) == 2 and all(len(r["ids"]) == r["length"] > 0 for r in rows)
