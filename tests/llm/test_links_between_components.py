"""Steps of the search for groups take up links between components only, and draw few partners whatever the number of cells."""

import random

from pyspark.sql import functions as F

from tidelog.llm import jaccard
from tidelog.session import materialize

N = 120


def _texts():
    draw = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    for i in range(N):
        words = list(base)
        for _ in range(1 + i % 3):
            words[draw.randrange(90)] = f"x{draw.randrange(10**9)}"
        yield i, " ".join(words)


def test_links_are_followed_once(spark, monkeypatch):
    """Each link that is followed joins components: fewer than members in all, though there are several steps."""
    monkeypatch.setattr(jaccard, "FEW", 8)
    followed, plain = [], jaccard.components

    def counted(nodes, links):
        followed.append(links.count())
        return plain(nodes, links)

    monkeypatch.setattr(jaccard, "components", counted)
    rows = list(_texts())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(86)} for i, t in rows}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((of[a], of[b]))
                of = {i: x if c == y else c for i, c in of.items()}
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == of
    assert len(followed) > 1
    assert sum(followed) <= 2 * N


def test_partners_of_a_document_do_not_grow_with_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 8)
    monkeypatch.setattr(jaccard, "CELL", 16)
    found = jaccard.sets([t for _, t in _texts()])
    nodes = spark.createDataFrame([(i, len(s), s.astype("int64").tolist()) for i, s in enumerate(found)], "node bigint, n bigint, grams array<bigint>")
    prefixes = materialize(jaccard._prefixes(materialize(nodes, "nodes"), jaccard.PERCENT), "prefixes")
    known = prefixes.select("node", F.col("node").alias("component"))
    drawn = jaccard._across(prefixes, known, jaccard.PERCENT, jaccard.PICKS).groupBy("a").count()
    assert 0 < drawn.agg(F.max("count")).first()[0] <= jaccard.PICKS
