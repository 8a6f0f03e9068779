"""Scoring a stream rewrites each message once: what several jobs read is stored."""

from tidelog.plans import stream_queries as SQ
from tidelog.plans.registry import QUERIES


def test_training_rows_and_templates_are_stored(spark, sf_dir, monkeypatch):
    names, plain = [], SQ.materialize
    monkeypatch.setattr(SQ, "materialize", lambda df, name: names.append(name) or plain(df, name))
    scored = QUERIES["stream_model_scores"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert scored.count() == scored.select("id").distinct().count() == events.count()
    assert names.count("trained") == 1 and names.count("templated") == 3
