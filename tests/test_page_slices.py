"""Texts of pages leave a task in slices, whatever the size of Spark's batches."""

import pytest

from tidelog.operators import documents as D


@pytest.mark.parametrize("pages", [1, 2, 64])
def test_slices_give_every_page_its_text(spark, monkeypatch, pages):
    monkeypatch.setattr(D, "PAGES", pages)
    rows = [(i, f"u{i}", None if i == 3 else f"<body><p>text {i}</p></body>") for i in range(7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    found = D.extract_text(df, ["page_id", "url"]).collect()
    assert sorted(tuple(r) for r in found) == [(i, f"u{i}", "" if i == 3 else f"text {i}") for i in range(7)]
