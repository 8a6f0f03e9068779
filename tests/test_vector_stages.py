"""Vector stages against plain arithmetic, and no function that runs row by row in their plans."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidelog.operators import models, squared_hinge


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_logs_of_counts(spark):
    rows = [(0, Vectors.sparse(5, [1, 4], [1.0, 8.0])), (1, Vectors.sparse(5, [], [])), (2, Vectors.sparse(5, [0], [3.0]))]
    df = spark.createDataFrame(rows, ["id", "v"]).repartition(2)
    out = models.LogCounts(inputCol="v", outputCol="logs").transform(df)
    assert "BatchEvalPython" not in plan_of(out)
    got = {r["id"]: r["logs"] for r in out.collect()}
    assert got[0].indices.tolist() == [1, 4] and got[0].values.tolist() == pytest.approx([1.0, 1 + math.log(8)])
    assert got[1].size == 5 and not len(got[1].values)
    assert got[2].toArray().tolist() == pytest.approx([1 + math.log(3), 0, 0, 0, 0])


def test_linear_heads(spark):
    heads = np.array([[1.0, -2.0, 0.5], [0.0, 4.0, 1.0]])
    model = squared_hinge.LinearHeadsModel(coefficients=heads.ravel().tolist(), intercepts=[0.25, -1.0])
    vectors = [Vectors.sparse(3, [1], [2.0]), Vectors.dense([1.0, 0.0, 3.0]), Vectors.sparse(3, [], [])]
    df = spark.createDataFrame(list(enumerate(vectors)), ["id", "features"])
    out = model.transform(df)
    assert "BatchEvalPython" not in plan_of(out)
    for r in out.collect():
        want = heads @ vectors[r["id"]].toArray() + [0.25, -1.0]
        assert r["rawPrediction"].toArray() == pytest.approx(want)
        assert r["prediction"] == int(np.argmax(want))
    assert model.transform(df.filter("id < 0")).collect() == []


def test_parts_of_vectors(spark):
    df = spark.createDataFrame([(0, Vectors.sparse(9, [2, 7], [1.5, 2.5])), (1, Vectors.dense([4.0, 5.0]))], ["y", "features"])
    out = squared_hinge._sparse_rows(df, "features", "y")
    got = {r["y"]: (r["size"], r["indices"], r["values"]) for r in out.select("*", F.lit(1)).collect()}
    assert got == {0: (9, [2, 7], [1.5, 2.5]), 1: (2, [0, 1], [4.0, 5.0])}
    assert "json" not in plan_of(out).lower()
