"""Training by feature blocks gives the model of training on the driver."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidelog.operators import block_hinge
from tidelog.operators.squared_hinge import SquaredHingeClassifier

FEATURES, CLASSES = 11, 3


def rows():
    rng = np.random.default_rng(4)
    made = []
    for i in range(70):
        indices = np.sort(rng.choice(FEATURES, rng.integers(0, 5), replace=False))
        made.append((int(i % CLASSES if i % 4 else 0), indices.tolist(), rng.normal(0, 1, len(indices)).tolist()))
    return made


def test_the_model_of_blocks_equals_the_one_of_the_driver(spark):
    data = rows()
    df = spark.createDataFrame(data, "y int, indices array<int>, values array<double>").repartition(3)
    frame = spark.createDataFrame([(Vectors.sparse(FEATURES, i, v), float(y)) for y, i, v in data], ["features", "label"])
    want = SquaredHingeClassifier(tol=1e-3).fit(frame)
    heads = np.array(want.getOrDefault(want.coefficients)).reshape(CLASSES, FEATURES)
    bias = np.array(want.getOrDefault(want.intercepts))
    model = block_hinge.fit(df, FEATURES, CLASSES, tol=1e-3, feature_block=5, row_block=16)
    got = np.concatenate([np.array(r["w"]).reshape(CLASSES, 5) for r in model.orderBy("fb").collect()], axis=1)
    assert np.abs(got[:, :FEATURES] - heads).max() < 1e-6 and np.abs(got[:, FEATURES] - bias).max() < 1e-6
    found = block_hinge.scores(df, model, FEATURES, CLASSES, feature_block=5, row_block=16).collect()
    plain = sorted((y, [round(float(h[i] @ np.array(v) + b), 5) for h, b in zip(heads, bias)] if i else [round(float(b), 5) for b in bias]) for y, i, v in data)
    assert sorted((r["y"], [round(s, 5) for s in r["scores"]]) for r in found) == [(y, s) for y, s in plain]


def test_the_two_loops_on_products_give_the_direction_of_vectors():
    from tidelog.operators.squared_hinge import _inverse_hessian_times

    rng = np.random.default_rng(2)
    for n in (0, 1, 4):
        steps = [rng.normal(size=30) for _ in range(n)]
        turns = [s + 0.1 * rng.normal(size=30) for s in steps]
        w, g = rng.normal(size=30), rng.normal(size=30)
        all_ = np.stack([w, g, *steps, *turns])
        factors = block_hinge._direction(all_ @ all_.T, n)
        assert np.abs(factors @ all_ + _inverse_hessian_times(g, steps, turns)).max() < 1e-10


def test_rows_of_one_class_and_rows_without_features(spark):
    df = spark.createDataFrame([(0, [], []), (0, [1], [1.0]), (0, [0, 1], [1.0, 2.0])], "y int, indices array<int>, values array<double>")
    model = block_hinge.fit(df, 2, 2, feature_block=2)
    assert model.count() == 2
    best = block_hinge.scores(df, model, 2, 2, feature_block=2).select((F.array_position("scores", F.array_max("scores")) - 1).alias("b"))
    assert {r["b"] for r in best.collect()} == {0}
