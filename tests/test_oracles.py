"""Every registered query with DuckDB text gives the same rows as that text."""

import pytest
from oracle_check import compare, connect

from tidelog.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


# Rows of these may be empty at the smallest size.
MAY_BE_EMPTY = {"ingested_last_15_minutes", "window_stats_last_12_hours"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, sf_dir, name):
    _, _, verdict = compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES[name])
    assert verdict == "ok" or (verdict == "EMPTY" and name in MAY_BE_EMPTY)


def test_every_query_without_oracle_is_known():
    assert set(QUERIES) - set(ORACLES) == {
        "random_forest_predictions", "logistic_regression_predictions", "linear_svc_predictions",
        "naive_bayes_predictions", "train_and_compare", "cross_validation", "score_events", "session_classifier", "best_session_report", "linear_svc_by_blocks",
        "html_text", "page_chunks", "chunk_vectors", "explain_top_incidents", "model_calls",
    }
