"""Pairs of a large group of near copies are not compared by the square."""

import random

from tidelog.llm import jaccard

N = 150


def _rows():
    draw = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(N):
        words = list(base)
        for _ in range(1 + i % 2):
            words[draw.randrange(90)] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def _groups(rows):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((of[a], of[b]))
                of = {i: x if c == y else c for i, c in of.items()}
    return of


def test_links_verified_grow_with_members(spark, monkeypatch):
    """Without the leaders, all but the drawn partners would be left to the last pass."""
    monkeypatch.setattr(jaccard, "ORDERS", 1)
    seen, plain = [], jaccard._linked

    def counted(pairs, *args):
        seen.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(jaccard, "_linked", counted)
    rows = _rows()
    found = {r["doc_id"]: r["component_id"] for r in jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == _groups(rows)
    assert sum(seen) <= 5 * N
