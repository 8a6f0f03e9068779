"""The rewrite chain runs once per event and over even tasks, and its short cuts change no text."""

import pytest
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions import rewrites as R
from tidelog.functions.text import contains_any
from tidelog.operators.label_templates import label_events
from tidelog.plans import views
from tidelog.plans.collect_queries import tagged
from tidelog.session import spread

TEXTS = [
    None, "", " ", "a b", "a  b", "\ta  b\n", "  x  y  ", "a \tb\t c",
    "/vmfs/volumes//ds1/x", "/VMFſ/VOLUMES//ds1/x", "/vmfs/volumeſ//d/", "s.NAA.60a98 .naa.x/y", "Vol 'A b' vol 'c' xvol 'd'",
    "at 2024-03-01t10:11:12.5z done, x2024-03-01t10:11z", "01234567-89ab-4abc-8def-0123456789ab 01234567-89ab-4abc-8def-0123456789abc",
    "10.0.0.1 1.2.3.4.5 x10.0.0.1 ١٠.0.0.1", "0xbeef 0x", "cpu7 xcpu7 cpu cpu٧ écpu1 cpu1́", "dlx: 5 dlx:6", "opid=ab-1 _opid=q",
    "sid=a sid= lro-1 lro-x task-12 task-12a", "5 a5 5a ٥ 5́ ́5", "vim.Retrieve ſoap.x ſdk.y apı.z api.a-b", '"QUERY" query Logout logın logIn K querý',
    "abcdef012345 ABCDEF0123456789 xabcdef012345", "a failed login", "Timed Out 403",
]


@pytest.mark.parametrize("rule", [*V.DATASTORE_RULES, *V.FIELD_RULES, *V.SECOND_PASS_RULES], ids=lambda r: r[0])
def test_rules_change_what_their_patterns_change(spark, rule):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(t.upper(),) for t in TEXTS if t], "t string")
    plain = F.regexp_replace("t", "(?U)" + rule[1], rule[2])
    assert rows.filter(~plain.eqNullSafe(R.apply_rule(F.col("t"), rule))).collect() == []


def test_spaces_hosts_and_words(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, "NODE-1-2 xnode-1-2 node-1-2.infra.example.com"]], "t string")
    assert rows.filter(~F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).eqNullSafe(R.collapse_spaces(F.col("t")))).collect() == []
    plain = F.regexp_replace(F.lower("t"), "(?U)(?i)" + views.HOST_PATTERN, "<HOST>")
    assert rows.filter(~plain.eqNullSafe(R.mask_hosts(F.col("t"), views.HOST_PATTERN))).collect() == []
    found = rows.select("t", contains_any(F.col("t"), ["failed", "403"]).alias("x")).collect()
    assert all(r["x"] == (None if r["t"] is None else "failed" in r["t"] or "403" in r["t"]) for r in found)


def test_chain_is_spelled_once_in_the_plan(spark):
    plan = tagged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("node-") == 1
    rows = spark.createDataFrame([(1, "x", "a", "b", "p"), (2, " ", "a", "b", "p"), (3, None, "a", "b", "p")], "id int, template string, event_type string, service string, platform string")
    assert [r["id"] for r in label_events(rows).collect()] == [1]


def test_tasks_of_events_are_bounded_by_rows(spark):
    rows = spark.range(1000, numPartitions=1)
    assert spread(rows, rows=10).rdd.getNumPartitions() >= 100
    assert spread(rows, rows=10).count() == 1000
