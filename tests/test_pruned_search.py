"""Search by pivots: the rows of the plain search and of brute force, and how much of the work it leaves out."""

import numpy as np
import pytest

from tidelog.operators import retrieval as R


def table(spark, rows, key="id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} bigint, vector array<double>")


def brute(queries, vectors, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1.0)
    out = {}
    for q, v in queries:
        scores = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in vectors)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(search):
    out: dict = {}
    for r in sorted(search.hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    return out


def clustered(n, dim, centers, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dim))
    return middle[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clustered", "random", "one direction"])
@pytest.mark.parametrize("part", [7, 10_000])
def test_equals_brute_force(spark, kind, part):
    rng = np.random.default_rng(1)
    made = {"clustered": clustered(300, 8, 6, 0.05, 2), "random": rng.normal(size=(300, 8)), "one direction": np.outer(rng.integers(1, 9, 300), np.ones(8))}[kind]
    vectors = list(enumerate(made))
    asked = [(1000 + i, v) for i, v in enumerate(made[::10])]
    got = R.search_by_pivots(table(spark, asked, "query_id"), table(spark, vectors), k=4, part=part, block=5, ring=0.1)
    want = brute(asked, vectors, 4)
    ours = found(got)
    assert {q: [s for _, s in rows] for q, rows in ours.items()} == {q: pytest.approx([s for _, s in rows], abs=1e-8) for q, rows in want.items()}
    if kind != "one direction":  # there, rounding orders scores that are equal
        assert {q: [i for i, _ in rows] for q, rows in ours.items()} == {q: [i for i, _ in rows] for q, rows in want.items()}
    assert got.pairs == 300 * len(asked) and got.compared <= got.pairs


def test_clusters_are_left_out(spark):
    """Tight clusters: most pairs are ruled out, with the same rows as the search that meets all."""
    made = clustered(4000, 16, 20, 0.03, 3)
    vectors, asked = table(spark, enumerate(made)), table(spark, [(i, v) for i, v in enumerate(made[::40])], "query_id")
    got = R.search_by_pivots(asked, vectors, k=5, part=100)
    plain = {(r["query_id"], r["rank"]): r["id"] for r in R.top_passages(asked, vectors, k=5).collect()}
    assert {(r["query_id"], r["rank"]): r["id"] for r in got.hits.collect()} == plain
    assert got.compared < 0.25 * got.pairs


def test_zeros_nulls_repeats_and_few(spark):
    one = [1.0, 0.0]
    vectors = [(1, [0, 0]), (2, one), (3, one), (4, [0, 1]), (5, None), (6, [-1, 0]), (7, [])]
    asked = [(1, one), (2, [0, 0]), (3, [0, -2]), (4, None)]
    got = found(R.search_by_pivots(table(spark, asked, "query_id"), table(spark, vectors), k=3, part=1))
    assert got == {1: [(2, 1.0), (3, 1.0), (1, 0.0)], 2: [(1, 0.0), (2, 0.0), (3, 0.0)], 3: [(1, 0.0), (2, 0.0), (3, 0.0)]}
    few = found(R.search_by_pivots(table(spark, asked, "query_id"), table(spark, vectors[:2]), k=3))
    assert few[1] == [(2, 1.0), (1, 0.0)]
    nothing = R.search_by_pivots(table(spark, asked, "query_id"), table(spark, [(5, None)]), k=3)
    assert nothing.hits.collect() == [] and nothing.hits.columns == ["query_id", "id", "score", "rank"]
    assert found(R.search_by_pivots(table(spark, [], "query_id"), table(spark, vectors[:2]))) == {}
    zeros = found(R.search_by_pivots(table(spark, asked[:1], "query_id"), table(spark, [(9, [0, 0]), (8, [0, 0])])))
    assert zeros == {1: [(8, 0.0), (9, 0.0)]}
