"""Search by pivots where nothing can be left out: rows grow with queries times bundles, not with queries times parts."""

import numpy as np

from tidelog.operators import retrieval as R


def test_rows_do_not_grow_with_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "VECTOR_PART", 200)
    stored, plain = {}, R.materialize

    def counted(df, name):
        out = plain(df, name)
        stored[name] = stored.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(R, "materialize", counted)
    made = np.random.default_rng(5).normal(size=(600, 16))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "id bigint, vector array<double>")
    asked = vectors.filter("id < 40").withColumnRenamed("id", "query_id")
    got = R.search_by_pivots(asked, vectors, k=3, part=10, block=7)
    plain_hits = {(r["query_id"], r["rank"]): r["id"] for r in R.top_passages(asked, vectors, k=3).collect()}
    assert {(r["query_id"], r["rank"]): r["id"] for r in got.hits.collect()} == plain_hits
    assert got.hits.count() == 120
    pairs = sum(n for name, n in stored.items() if "pairs" in name)
    assert pairs <= 40 * (2 + 4)  # a query meets two bundles at first and four in all, and 60 parts
    assert stored["first-hits"] <= 40 * 2 * 3
