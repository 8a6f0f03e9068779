"""Trained classifiers on small data: wiring, objective, persistence, determinism."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidelog.operators import complement_bayes, models, terms
from tidelog.operators.squared_hinge import SquaredHingeClassifier

TEXTS = {
    "error": ["connection refused by vpxa", "request timeout upstream", "disk failure on path"],
    "important": ["virtual machine powered on", "snapshot created for vm", "vm migrated to host"],
    "noise": ["checking liveness of agent", "opening slot count file", "heartbeat sent to agent"],
    "security_noise": ["user login session opened", "session token refreshed", "logout of user session"],
}


@pytest.fixture(scope="module")
def data(spark):
    rows = [(f"{t} {i % 3} copy", label) for label, texts in TEXTS.items() for t in texts for i in range(6)]
    return spark.createDataFrame(rows, "template string, label string")


@pytest.fixture(scope="module")
def trained(data):
    return models.train_models(data, trees=20, depth=8)


def test_all_models_learn(data, trained):
    rows = models.evaluate_models(data, trained).collect()
    assert len(rows) == 4 and all(r["macro_f1"] >= 0.95 for r in rows)


def test_save_and_load(data, trained, tmp_path):
    models.save_models({"linearsvc": trained["linearsvc"], "naive_bayes": trained["naive_bayes"]}, str(tmp_path))
    again = models.load_model(str(tmp_path))
    a = models.predict(data, trained["linearsvc"]).select("template", "best", "scores").distinct().orderBy("template").collect()
    b = models.predict(data, again).select("template", "best", "scores").distinct().orderBy("template").collect()
    assert a == b


def test_score_events(spark, data, trained):
    events = data.select("template").withColumn("id", F.monotonically_increasing_id()).unionByName(
        spark.createDataFrame([("zzz qqq", 10_000), (None, 10_001)], "template string, id long")
    )
    rows = {r["id"]: r for r in models.score_events(events, trained["linearsvc"]).collect()}
    assert len(rows) == events.count()
    assert rows[10_000]["predicted_label"] == "anomaly" and rows[10_000]["risk_score"] == 15
    assert rows[10_001]["predicted_label"] is None


def test_table_bayes_equals_library_bayes(spark, data, trained):
    rows = [(i, r["template"], r["label"]) for i, r in enumerate(data.collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    classes = sorted(TEXTS)
    vocabulary = terms.fit_vocabulary(docs)
    weighted = terms.tfidf(docs, vocabulary)
    model = complement_bayes.fit(weighted, docs, vocabulary, classes)
    scored = complement_bayes.decision_scores(weighted, model, 4).join(docs, "doc_id").orderBy("doc_id").collect()
    library = models.predict(docs.withColumnRenamed("text", "template"), trained["naive_bayes"]).orderBy("doc_id").collect()
    for a, b in zip(scored, library):
        assert np.allclose(a["scores"], b["scores"], atol=1e-6) or np.allclose(
            np.array(a["scores"]) - a["scores"][0], np.array(b["scores"]) - b["scores"][0], atol=1e-6
        )


def test_squared_hinge_reaches_the_minimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3)
    model = SquaredHingeClassifier(maxIter=200, tol=1e-7).fit(df)
    heads = np.array(model.getOrDefault(model.coefficients)).reshape(3, 5)
    bias = np.array(model.getOrDefault(model.intercepts))
    counts = np.bincount(y, minlength=3)
    for c in range(3):
        sign = np.where(y == c, 1.0, -1.0)
        weight = np.where(y == c, 60 / (3 * counts[c]), 1.0)
        slack = np.maximum(0, 1 - sign * (x @ heads[c] + bias[c]))
        push = -2 * weight * sign * slack
        gradient = np.append(heads[c] + x.T @ push, bias[c] + push.sum())
        assert np.abs(gradient).max() < 1e-3


def test_cross_validation(data):
    keyed = data.withColumn("key", F.concat("template", F.lit("#"), F.monotonically_increasing_id()))
    row = models.cross_validate(keyed, "key", names=["naive_bayes"], k=3).first()
    assert row["mean"] >= 0.95 and len(row["folds"]) == 3 and row["ci_low"] <= row["mean"] <= row["ci_high"]


def test_best_report(data, trained):
    table = models.evaluate_models(data, {"naive_bayes": trained["naive_bayes"]})
    rows = models.best_report(data, data, table).collect()
    assert {r["label"] for r in rows} == set(TEXTS) and all(r["f1"] >= 0.9 and r["model"] == "naive_bayes" for r in rows)


def test_lookup_join_ways_agree(spark):
    from tidelog.operators.joins import lookup_join

    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = spark.createDataFrame([("hot", 333, 1.5)] + [(f"k{i}", 1, float(i)) for i in range(0, 50, 2)], "k string, n int, v double")
    for how in ("inner", "left"):
        small = lookup_join(rows, table, "k", ["id"], "n", how)
        large = lookup_join(rows, table, "k", ["id"], "n", how, max_bytes=3, hot_keys=2)
        assert small.columns == large.columns == ["id", "k", "v"] and [f.dataType for f in small.schema] == [f.dataType for f in large.schema]
        small, large = (x.orderBy("id").collect() for x in (small, large))
        assert small == large and len(small) == (1000 if how == "left" else len(small))
