"""Numbers of a vocabulary's terms and vectors of documents, against plain Python; the plan has no task for all terms."""

import math

import pytest
from pyspark.sql import functions as F

from tidelog.operators import segments, terms


def test_index_is_the_place_by_count_and_no_task_holds_all(spark):
    rows = [(f"t{i:03d}", 2, i * 7 % 40, 1.0) for i in range(300)]
    made = spark.createDataFrame(rows, "term string, df bigint, cf bigint, idf double").repartition(5)
    found = segments.with_index(made)
    want = {t: k for k, (t, *_) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert {r["term"]: r["index"] for r in found.collect()} == want
    assert found.columns == ["term", "df", "cf", "idf", "index"] and dict(found.dtypes)["index"] == "int"
    assert segments.with_index(made.limit(0)).count() == 0


def test_terms_meet_the_vocabulary_once(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "x", 9), (2, "b", 3), (3, "x", 1)], "doc_id bigint, term string, tf bigint")
    vocabulary = spark.createDataFrame([("a", 2, 2, 1.5, 1), ("b", 2, 4, 1.25, 0)], "term string, df bigint, cf bigint, idf double, index int")
    found = terms.vectors(counts, vocabulary)
    rows = {r["doc_id"]: (r["indices"], r["values"]) for r in found.collect()}
    length = math.hypot(2 * 1.5, 1.25)
    assert rows.keys() == {1, 2} and rows[2] == ([0], [1.0])
    assert rows[1][0] == [0, 1] and rows[1][1] == pytest.approx([1.25 / length, 3 / length])
    weighed = {(r["doc_id"], r["index"]): r["w"] for r in terms.weigh(counts, vocabulary).join(vocabulary.select("term", "index"), "term").collect()}
    assert weighed == pytest.approx({(d, i): w for d, (at, ws) in rows.items() for i, w in zip(at, ws, strict=True)})
    assert found.filter(F.size("indices") != F.size("values")).count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
