"""Training by feature blocks keeps nothing as long as the vocabulary: its tables are as long as the rows."""

import os

import numpy as np
from pyspark.sql import functions as F

from tidelog.operators import block_hinge
from tidelog.session import shared_dir

FEATURES = 300_000


def _rows(spark, features):
    rng = np.random.default_rng(9)
    data = [(int(i % 2), np.sort(rng.choice(features, 6, replace=False)).tolist(), rng.normal(0, 1, 6).tolist()) for i in range(40)]
    return spark.createDataFrame(data, "y int, indices array<int>, values array<double>").coalesce(2)


def _stored(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return {f"{at}/{f}": os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder) for f in files}


def test_tables_of_the_steps_are_as_long_as_the_rows(spark):
    df = _rows(spark, FEATURES)
    before = _stored(spark)
    block_hinge.fit(df, FEATURES, 2, tol=0.2)
    made = {k: v for k, v in _stored(spark).items() if k not in before and "/coefficients-" not in k}
    assert sum(made.values()) < 2_000_000  # one vector of the coefficients has 4,800,000 bytes
    assert len({k.split("/row-blocks-")[1].split("/")[0] for k in made if "/row-blocks-" in k}) <= 2


def test_bands_of_any_size_sent_or_joined_give_one_model(spark):
    df = _rows(spark, 30).localCheckpoint()
    made = []
    for options in ({}, {"band": 7}, {"band": 7, "sent_bytes": 0}):
        model = block_hinge.fit(df, 30, 2, tol=0.1, feature_block=8, row_block=16, **options)
        found = block_hinge.scores(df, model, 30, 2, feature_block=8, row_block=16, band=options.get("band", 1000))
        assert found.count() == 40
        made.append(np.array([r["w"] for r in model.orderBy("fb").collect()]))
        assert found.filter((F.col("scores")[1] > F.col("scores")[0]).cast("int") == F.col("y")).count() > 30
    assert np.abs(made[0] - made[1]).max() < 1e-8 and np.abs(made[0] - made[2]).max() < 1e-8
