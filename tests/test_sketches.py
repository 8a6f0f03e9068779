"""Sketches by run against exact counts and ranks; exact quantiles narrowed by bins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import sketches


def _position(values, q):
    ordered, position = sorted(values), q * (len(values) - 1)
    low = int(position)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (position - low)


def _cases():
    rng = random.Random(3)
    return {
        "even": [rng.random() for _ in range(3000)],
        "wide": [math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1]) for _ in range(3000)],
        "one value holds nearly all": [7.0] * 2900 + [rng.random() * 20 for _ in range(100)],
        "two values": [1.0] * 1000 + [2.0] * 1000,
        "far apart": [0.0] * 1500 + [1e300] * 3 + [float(i) for i in range(1500)],
        "single": [4.5],
    }


@pytest.mark.parametrize("name", list(_cases()))
@pytest.mark.parametrize("q", [0.0, 0.33, 0.5, 0.95, 1.0])
def test_exact_quantile_takes_passes(spark, name, q):
    values = _cases()[name]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    n, got = sketches.exact_quantile(df, "v", q, bins=4, left=3)
    assert n == len(values)
    assert got == pytest.approx(_position(values, q), rel=1e-12)


def test_exact_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert sketches.exact_quantile(df, "v", 0.5) == (0, None)


def test_passes_grow_with_the_logarithm(spark, monkeypatch):
    passes = []
    counted = sketches._counted
    monkeypatch.setattr(sketches, "_counted", lambda rows, edges: passes.append(len(edges)) or counted(rows, edges))
    df = spark.range(200_000).select((F.xxhash64("id") / 7).alias("x"))
    n, _ = sketches.exact_quantile(df, "x", 0.95, bins=64, left=100)
    assert n == 200_000 and len(passes) <= 3 and max(passes) <= 65


def test_ranges_of_runs(spark):
    """Ids that come again in the next run count once over both; null ids and values are counted as rows only."""
    rows = spark.range(40_000).selectExpr("id % 20000 as id", "cast(id div 10000 as int) as run", "'p' as platform", "cast(id as double) as v")
    odd = spark.createDataFrame([(None, 0, "p", None), (None, 9, "q", None), (5, 0, "p", float("nan"))], "id bigint, run int, platform string, v double")
    kept = sketches.run_sketches(rows.unionByName(odd), ["run", "platform"], "id", "v")
    spans = spark.createDataFrame([(0, 2), (1, 3), (0, 4), (9, 10), (50, 60)], "start int, end int")
    out = {(r["start"], r["end"], r["platform"]): r for r in sketches.over_ranges(kept, spans, ["platform"], run="run")
           .select("start", "end", "platform", "n", sketches.distinct_ids().alias("ids"), sketches.quantile(0.5).alias("v")).collect()}
    assert set(out) == {(0, 2, "p"), (1, 3, "p"), (0, 4, "p"), (9, 10, "q")}
    for span, n, ids, middle in [((0, 2), 20_002, 20_000, 10_000), ((1, 3), 20_000, 20_000, 20_000), ((0, 4), 40_002, 20_000, 20_000)]:
        r = out[(*span, "p")]
        assert r["n"] == n and abs(r["ids"] - ids) < 0.04 * ids and abs(r["v"] - middle) < 0.01 * 40_000
    empty = out[(9, 10, "q")]
    assert (empty["n"], empty["ids"], empty["v"]) == (1, 0, None)
