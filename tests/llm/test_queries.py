"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import os
import sys

import pytest
from oracle_check import compare, connect

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tidelog.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name])[2] == "ok"


def test_thirteen_queries_and_the_pipeline_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= set(names)


def test_pipeline_equals_plain_stages(spark, sf_dir):
    """Each stage but the first (tested by its own brute force) redone by the brute force of its operator's tests."""
    from test_text_operators import ALNUM, FOLD, SPACED, brute_hits, brute_removed, shingles

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    rows = sorted((r["doc_id"], r["text"], "") for r in kept.collect())
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and (both := len(a & b)) and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = max(label[i], label[j]), min(label[i], label[j])
                label = {k: y if v == x else v for k, v in label.items()}
    stage = corpus_pipeline.near_copies(spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in stage.collect()) == sorted({v for v in label.values()})
    stage = spark.createDataFrame(stage.collect(), docs.schema)
    rows = sorted((r["doc_id"], r["text"], "") for r in stage.collect())
    cut = corpus_pipeline.repeated_passages(spark, stage, sf_dir)
    got = {r["doc_id"]: r for r in cut.collect()}
    for doc, words, gone in brute_removed(rows):
        assert SPACED.findall(got[doc]["text"]) == [w for w, g in zip(words, gone) if not g] and got[doc]["n_chars"] == len(got[doc]["text"])
    cut = spark.createDataFrame(list(got.values()), docs.schema)
    rows = sorted((r["doc_id"], r["text"], "") for r in cut.collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontamination(spark, cut, sf_dir)
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    for doc, words, hit, _ in brute_hits(rows, items):
        assert ALNUM.findall(got[doc].translate(FOLD)) == [w for w, h in zip(words, hit) if not h]
    assert clean.columns == docs.columns
    packed = corpus_pipeline.packed(spark, spark.createDataFrame(clean.collect(), docs.schema), sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(got)
