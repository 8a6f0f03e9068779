"""Template table, selection, incidents, metrics and sessions on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidelog.operators import collect, incidents, label_templates, metrics, reports, sampling, selection, sessions
from tidelog.operators.inference import with_context


def test_label_share_decides(spark):
    def counts(good, bad):
        rows = [("t", "error", "e", "s", "p", good), ("t", "noise", "e", "s", "p", bad)]
        return spark.createDataFrame(
            rows, "template string, label string, event_type string, service string, platform string, n long"
        )

    exact = label_templates.label_templates(counts(80, 20)).first()
    below = label_templates.label_templates(counts(79, 21)).first()
    assert (exact["label"], exact["label_confidence"]) == ("error", 0.8)
    assert (below["label"], below["label_confidence"]) == ("unknown", 0.79)
    assert exact["label_candidates"] == '{"error": 80, "noise": 20}'


def test_blank_templates_drop_and_ties_take_lowest(spark):
    rows = [("failed x", "error", "b", "p"), ("failed x", "error", "a", "p"), ("  ", "error", "a", "p"), (None, "error", "a", "p")]
    events = spark.createDataFrame(rows, "template string, event_type string, service string, platform string")
    table = label_templates.label_templates(label_templates.template_counts(events)).collect()
    assert [(r["template"], r["service"], r["count"]) for r in table] == [("failed x", "a", 2)]


def test_label_on_raw_sees_login(spark):
    events = spark.createDataFrame(
        [("vpxuser login from <IP>", "other", "unknown", "p")], "template string, event_type string, service string, platform string"
    )
    assert label_templates.label_events(events).first()["label"] == "noise"
    assert label_templates.label_events(events, label_on="raw").first()["label"] == "security_noise"


def test_null_ids_are_kept_unless_parity(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "id string, n int")
    order = [F.asc("n")]
    assert sorted(r["n"] for r in collect.first_by_id(df, ["id"], order).collect()) == [1, 2, 3]
    assert sorted(r["n"] for r in collect.first_by_id(df, ["id"], order, keep_null_ids=False).collect()) == [1, 3]


def test_recent_or_latest(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, t0), (2, t0 + dt.timedelta(hours=1)), (3, t0 + dt.timedelta(hours=1))], "id int, run_ts timestamp")
    near = selection.recent_or_latest(df, F.lit(t0 + dt.timedelta(hours=1, minutes=10)))
    far = selection.recent_or_latest(df, F.lit(t0 + dt.timedelta(days=3)))
    wide = selection.recent_or_latest(df, F.lit(t0 + dt.timedelta(hours=1)), minutes=60)
    assert sorted(r["id"] for r in near.collect()) == [2, 3]
    assert sorted(r["id"] for r in far.collect()) == [2, 3]
    assert sorted(r["id"] for r in wide.collect()) == [1, 2, 3]


_INC = "id int, ts timestamp, run_ts timestamp, template string, source string, risk_score int"


def _incident(i, template, source, risk):
    t = dt.datetime(2024, 1, 1, 0, i)
    return (i, t, t, template, source, risk)


def test_assessment(spark):
    rows = [_incident(1, "a", "h3", 10), _incident(2, "a", "h1", 15), _incident(3, "b", "h2", 10), _incident(4, "b", None, 10)]
    df = spark.createDataFrame(rows, _INC)
    row = incidents.assess_all(df).first()
    assert (row["n"], row["urgent"], row["severity"], row["affected_hosts"]) == (4, True, "P1", ["?", "h1", "h2"])
    calm = incidents.assess_all(df.filter("risk_score < 15")).first()
    assert (calm["urgent"], calm["severity"]) == (False, "P3")
    none = incidents.assess_all(df.filter("false")).first()
    assert (none["n"], none["severity"], none["reason"], none["affected_hosts"]) == (0, "P4", "No anomalies detected", [])
    assert incidents.last_per_template(df).count() == 2
    text = incidents.alerts(df.withColumn("w", F.lit("x")), ["w"]).first()
    assert text["channel"] == "urgent" and "• `h1` a" in text["text"]


def test_incident_plans_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([_incident(1, "a", "h", 1)], _INC)
    plan = incidents.last_per_template(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in incidents.top_by_risk(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_report(spark):
    rows = [("error", "esxi", "Hostd", "t1"), ("noise", None, None, "t2")]
    df = spark.createDataFrame(rows, "predicted_label string, platform string, service string, template string").select(
        "*", F.lit("h").alias("source"), F.lit("m").alias("message"), F.lit(1).alias("id"),
        F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit(dt.datetime(2024, 1, 1)).alias("run_ts"), F.lit("2024-01-01").alias("period"),
    )
    text = reports.markdown_report(df, "period").first()["content"]
    assert "Events: 2" in text and "- unknown: 1" in text and "- t1" in text
    stats = {(r["dimension"], r["key"]): r["n"] for r in reports.window_stats(df).collect()}
    assert stats[("total", "")] == 2 and stats[("platform", "unknown")] == 1


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") < 700, "a").otherwise("b").alias("label"))
    parts = sampling.stratified_split(df, "id").groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {
        ("a", "test"): 140, ("a", "train"): 560, ("b", "test"): 61, ("b", "train"): 242,
    }
    assert sampling.stratified_split(df.withColumn("label", F.lit(None).cast("string")), "id").count() == 1003
    folds = sampling.stratified_folds(df, "id").groupBy("label", "fold").count()
    assert folds.groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0] <= 1


def test_metrics_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    rows = {r["label"]: r for r in metrics.per_class(metrics.confusion_counts(df)).collect()}
    assert round(rows["a"]["f1"], 4) == 0.5 and round(rows["b"]["f1"], 4) == 0.6667 and rows["c"]["f1"] == 0.0
    row = metrics.metrics_rows(df).first()
    assert row["accuracy"] == 0.5 and row["macro_f1"] == 0.3889 and row["f1_error"] == 0.0


def test_exact_percentile(spark):
    for values in ([5.0], [1.0, 2.0], [float(i * i % 97) for i in range(500)], [1.0] * 50 + [9.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.5, 0.95, 1.0):
            ordered = sorted(values)
            position = q * (len(values) - 1)
            low = int(position)
            high = min(low + 1, len(values) - 1)
            want = ordered[low] + (ordered[high] - ordered[low]) * (position - low)
            got = metrics.exact_percentile(df, "v", q, bins=8, left=5).first()["value"]
            assert abs(got - want) < 1e-9, (q, len(values))


def test_traces(spark):
    df = spark.createDataFrame([("[E5, E22,,E11]",), ("[]",), ("E1",)], "f string")
    assert [r[0] for r in df.select(sessions.parse_trace(F.col("f"))).collect()] == [["E5", "E22", "E11"], [], ["E1"]]
    traces = spark.createDataFrame([(1, "[E1,E2,E9]"), (2, "[]"), (3, None)], "trace_id int, features string")
    words = spark.createDataFrame([("E1", "one"), ("E1", "and"), ("E2", "two"), (None, "none")], "event_id string, template string")
    for limit in (10, 0):
        out = sessions.trace_text(traces, words, max_literal=limit)
        assert out.columns == ["trace_id", "features", "document"]
        assert {r["trace_id"]: r["document"] for r in out.collect()} == {1: "one two E9", 2: "", 3: None}


def test_segments_join_to_whole_traces(spark):
    events = spark.range(25).selectExpr("id % 2 as s", "id as pos_", "concat('e', id) as e").withColumn("pos", F.floor(F.col("pos_") / 2))
    for size in (1, 4, 100):
        whole = sessions.whole_traces(sessions.trace_segments(events, ["s"], "e", size), ["s"])
        assert {r["s"]: r["features"] for r in whole.collect()} == {s: "[" + ",".join(f"e{i}" for i in range(s, 25, 2)) + "]" for s in (0, 1)}


def test_positions_across_slices_and_missing_time(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "s", t + dt.timedelta(minutes=17 * i)) for i in range(50)] + [(99, "s", None)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    nameless = df.withColumn("k", F.lit(None).cast("string"))
    assert sorted(r["pos"] for r in sessions.positions(nameless, ["k"]).collect()) == list(range(51))
    got = {r["id"]: r["pos"] for r in sessions.positions(df, ["k"]).collect()}
    assert got[99] == 0 and all(got[i] == i + 1 for i in range(50))


def test_context_crosses_blocks(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "w", t + dt.timedelta(seconds=i), f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, w string, ts timestamp, template string")
    got = {r["id"]: r["context"] for r in with_context(df, ["w"], block=7).collect()}
    assert len(got) == 40
    assert all(got[i] == [f"t{j}" for j in range(max(0, i - 5), i)] for i in range(40))
