"""Sources, sinks and streams over files."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.operators.collect import normalize_events
from tidelog.plans.registry import QUERIES
from tidelog.schemas import EVENT, RAW_ENVELOPE
from tidelog.sources import events as E
from tidelog.sources import labels, pages, sinks
from tidelog.streaming import ingest

HOST = r"\bnode-\d+-\d+\b"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")


def test_bad_lines_fail_or_drop(spark, tmp_path):
    write(tmp_path / "events_20240101T000000Z.jsonl", [{"id": "a", "template": "t"}, "", "{broken", {"id": "b"}])
    kept = E.read_events(spark, str(tmp_path), strict=False)
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b"] and kept.columns == EVENT.fieldNames()
    with pytest.raises(Exception):
        E.read_events(spark, str(tmp_path)).collect()


def test_run_time_comes_from_the_file_name(spark, tmp_path):
    write(tmp_path / "events_20240101T101500Z.jsonl", [{"id": "a"}])
    write(tmp_path / "events_latest.jsonl", [{"id": "b"}])
    rows = E.with_run_time(E.read_events(spark, str(tmp_path)), "events").collect()
    assert [(r["id"], r["run_ts"].strftime("%H:%M")) for r in rows] == [("a", "10:15")]


def envelope(*messages):
    return {"messages": [{"_id": i, "message": {"gl2_message_id": g, "timestamp": t, "source": "Node-1-2", "message": m, "level": 3}} for i, g, t, m in messages]}


def test_envelopes_to_events(spark, tmp_path):
    write(tmp_path / "raw.jsonl", [envelope(("o1", "", "2024-01-01T00:00:01.000Z", "NODE-1-2 failed 7"), ("o2", "g2", None, "x")), {"messages": []}])
    flat = E.flatten_envelopes(E.read_envelopes(spark, str(tmp_path))).withColumn("platform", F.lit("esxi"))
    rows = {r["id"]: r for r in normalize_events(flat, HOST).collect()}
    assert set(rows) == {"o1", "g2"}
    assert (rows["o1"]["template"], rows["o1"]["host"], rows["o1"]["source"]) == ("<HOST> failed <NUM>", "<HOST>", "Node-1-2")
    assert rows["o1"]["event_type"] == "error" and rows["o1"]["label"] is None and rows["g2"]["timestamp"] is None
    assert normalize_events(flat, HOST).columns == EVENT.fieldNames()


def test_runs_are_replaced_not_repeated(spark, tmp_path):
    path = str(tmp_path / "events")
    first = spark.createDataFrame([("a", "r1"), ("b", "r2")], "id string, run_ts string")
    sinks.write_runs(first, path)
    sinks.write_runs(spark.createDataFrame([("c", "r2")], "id string, run_ts string"), path)
    stored = spark.read.parquet(path)
    assert sorted((r["id"], r["run_ts"]) for r in stored.collect()) == [("a", "r1"), ("c", "r2")]
    assert [r["id"] for r in sinks.pending_runs(stored, stored.filter("run_ts = 'r1'")).collect()] == ["c"]


def test_raw_audit_and_alert_sinks_replace_their_run(spark, tmp_path):
    df = spark.createDataFrame([("m", "esxi", "r1")], "text string, platform string, run_ts string")
    for _ in range(2):
        sinks.write_raw(df, str(tmp_path / "raw"))
        sinks.write_alerts(df.withColumn("channel", F.lit("daily")), str(tmp_path / "alerts"))
    sinks.write_raw(df.withColumn("run_ts", F.lit("r2")), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 2
    assert spark.read.json(str(tmp_path / "alerts")).filter("channel = 'daily'").count() == 1


def test_label_files(spark, tmp_path):
    rows = [('say "hi", all', "noise", "e", "s", "p", 2, 0.9, '{"noise": 2}'), ("line\nbreak", "error", "e", "s", "p", 5, 1.0, "{}"), ("z", "odd", "e", "s", "p", 1, 1.0, "{}")]
    df = spark.createDataFrame(rows, "template string, label string, event_type string, service string, platform string, count long, label_confidence double, label_candidates string")
    sinks.write_labels(df, str(tmp_path / "labels"))
    back = labels.read_labels(spark, str(tmp_path / "labels"))
    assert [r["template"] for r in back.orderBy(F.desc("count")).collect()] == ["line\nbreak", 'say "hi", all', "z"]
    assert labels.clean_labels(back).count() == 2
    sinks.write_candidates(df.withColumnRenamed("label", "suggested_label").withColumn("reason", F.lit("r")), str(tmp_path / "cand"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cand")).columns[:3] == ["template", "suggested_label", "reason"]


def test_trace_files(spark, tmp_path):
    write(tmp_path / "traces.csv", ["BlockId,Label,Type,Features", 'b1,Success,x,"[E5,E22]"', 'b2,Fail,,"[E5]"'])
    write(tmp_path / "templates.csv", ["EventId,EventTemplate", 'E5,"Receiving, block"'])
    rows = labels.read_traces(spark, str(tmp_path / "traces.csv")).collect()
    assert [(r["Label"], r["Features"]) for r in rows] == [("Success", "[E5,E22]"), ("Fail", "[E5]")]
    assert labels.read_trace_templates(spark, str(tmp_path / "templates.csv")).first()["EventTemplate"] == "Receiving, block"


def test_html_files(spark, tmp_path):
    write(tmp_path / "docs" / "vmware" / "a" / "x.html", ["<body>é</body>"])
    write(tmp_path / "docs" / "hyperv" / "y.html", ["<body>y</body>"])
    write(tmp_path / "docs" / "hyperv" / "y.txt", ["no"])
    rows = pages.read_html(spark, str(tmp_path / "docs")).collect()
    assert sorted((r["platform"], r["html"]) for r in rows) == [("hyperv", "<body>y</body>"), ("vmware", "<body>é</body>")]


def test_real_replacement_characters_stay(spark, tmp_path):
    """Bytes that are not UTF-8 go; U+FFFD and private characters that the page has stay."""
    (tmp_path / "docs" / "esxi").mkdir(parents=True)
    content = "a\ufffdb\ue000b\ue000a \ufffd".encode() + b"\xff\xc3|\xef\xbf" + "\ue000".encode() + b"\xfeb"
    (tmp_path / "docs" / "esxi" / "p.html").write_bytes(content)
    assert pages.read_html(spark, str(tmp_path / "docs")).first()["html"] == "a\ufffdb\ue000b\ue000a \ufffd|\ue000b"


def test_vectors_reports_evaluation(spark, tmp_path):
    chunks = spark.createDataFrame([("s", "p", 0, "t", [1.0])], "source string, platform string, chunk_id int, text string, vector array<float>")
    for _ in range(2):
        sinks.write_vectors(chunks, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    for text in ("old", "new"):
        sinks.write_reports(spark.createDataFrame([("2024-01-02", text)], "period string, content string"), str(tmp_path / "r"))
    sinks.write_reports(spark.createDataFrame([("2024-01-01", "first")], "period string, content string"), str(tmp_path / "r"))
    from tidelog.operators.reports import latest_report

    assert latest_report(sinks.read_reports(spark, str(tmp_path / "r"))).first()["content"] == "new"
    summary = spark.createDataFrame([("m", 0.5)], "model string, macro_f1 double")
    sinks.write_evaluation(str(tmp_path / "e"), "run1", summary, summary, summary, {"seed": "42"})
    sinks.write_evaluation(str(tmp_path / "e"), "run2", summary)
    assert spark.read.option("header", True).csv(str(tmp_path / "e" / "summary")).count() == 2
    assert spark.read.json(str(tmp_path / "e" / "run_meta")).filter("run_id = 'run1'").first()["value"] == "42"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    """Two overlapping files, then a third after a restart: every id once, alerts per batch."""
    def put(n, messages):
        write(tmp_path / "in" / "platform=esxi" / f"{n}.json", [envelope(*messages)])

    message = lambda i: (f"o{i}", f"g{i}", f"2024-01-01T00:{i:02d}:00.000Z", "connect failed" if i % 2 else "fine")
    put(1, [message(i) for i in range(6)])
    put(2, [message(i) for i in range(4, 9)])
    schema = RAW_ENVELOPE.add("platform", "string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def score(batch):
        failed = F.col("event_type") == "error"
        return batch.withColumn("predicted_label", F.when(failed, "error").otherwise("noise")).withColumn(
            "risk_score", F.when(failed, 10).otherwise(0)
        )

    def run():
        envelopes = ingest.envelope_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        ingest.start_scoring(ingest.event_stream(envelopes, HOST), score, out, checkpoint).awaitTermination()

    run()
    put(3, [message(i) for i in range(7, 11)])
    run()
    run()
    rows = spark.read.parquet(f"{out}/predictions").collect()
    assert sorted(r["id"] for r in rows) == sorted(f"g{i}" for i in range(11))
    assert {r["id"] for r in rows if r["predicted_label"] == "error"} == {f"g{i}" for i in range(1, 11, 2)}
    alerts = spark.read.parquet(f"{out}/alerts").collect()
    assert sum(r["n"] for r in alerts) == 5 and {r["channel"] for r in alerts} == {"daily"}


def test_earlier_copies_are_looked_for_by_day(spark, tmp_path):
    """A row from long ago makes only its own days read; rows without a time, and days next to the batch's, are looked at."""
    rows = "id string, timestamp timestamp, batch_id int, event_day date"
    written = [("old", "2020-01-01", 0), ("far", "2022-06-01", 0), ("near", "2024-01-01", 0), ("same", "2024-01-02", 1), ("none", None, 0), ("later", "2024-01-02", 3)]
    table = spark.createDataFrame(written, "id string, day string, batch_id int").withColumn("timestamp", F.expr("cast(day as timestamp)")).withColumn("event_day", F.to_date("day"))
    table.select(*[x.split()[0] for x in rows.split(", ")]).write.partitionBy("batch_id", "event_day").parquet(str(tmp_path / "p"))
    batch = spark.sql("select 'x' as id, timestamp '2020-01-01 05:00:00' as timestamp union all select 'y', timestamp '2024-01-02 01:00:00'")
    found = ingest._earlier_ids(batch, str(tmp_path / "p"), 3)
    assert sorted(r["id"] for r in found.collect()) == ["near", "none", "old", "same"]
    assert "PartitionFilters: [" in (plan := found._jdf.queryExecution().toString()) and "event_day" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    untimed = ingest._earlier_ids(batch.withColumn("timestamp", F.lit(None).cast("timestamp")), str(tmp_path / "p"), 3)
    assert [r["id"] for r in untimed.collect()] == ["none"]


def test_stream_dedupe_drops_old_state(spark, tmp_path):
    """Copies go, rows without an id stay, and the watermark moves although no such row comes late."""
    schema = "id string, timestamp timestamp"
    write(tmp_path / "in" / "1.json", [{"id": i, "timestamp": "2024-01-01T00:00:00Z"} for i in ("a", "a", "b", None, None)])
    write(tmp_path / "in" / "2.json", [{"id": i, "timestamp": "2024-01-02T00:00:00Z"} for i in ("c", "c")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = ingest.dedupe_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(r or "" for r in rows) == ["", "", "a", "b", "c"]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


@pytest.mark.parametrize("name", ["html_text", "page_chunks", "chunk_vectors", "explain_top_incidents", "model_calls"])
def test_queries_without_oracle_run(spark, sf_dir, name):
    import tidelog.plans.catalog  # noqa: F401

    assert QUERIES[name](spark, sf_dir).count() > 0


def _land_context(tmp_path, n, rows):
    import os

    write(tmp_path / "in" / f"{n}.json", [{"id": i, "ts": f"2024-01-01T{h:02d}:0{i % 10}:00Z", "k": k, "m": f"m{i}"} for i, h, k in rows])
    os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


CONTEXT = "id int, ts timestamp, k string, m string"


def test_context_goes_on_over_micro_batches(spark, tmp_path):
    """Two files, one after the other: the second file's first events have the first file's last ones before them."""
    from tidelog.streaming.context import context_stream, lists_in_state

    for n, ids in enumerate(([3, 1, 2], [5, 4, 6, 7])):
        _land_context(tmp_path, n, [(i, 0, "b" if i == 4 else "a") for i in ids])
    stream = spark.readStream.schema(CONTEXT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with lists_in_state(spark):
        query = context_stream(stream, "k", "m", n=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["id"]: r["context"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: [], 2: ["m1"], 3: ["m1", "m2"], 4: [], 5: ["m2", "m3"], 6: ["m3", "m5"], 7: ["m5", "m6"]}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_state_of_a_silent_key_ends(spark, tmp_path):
    """With two hours to keep, the values of ``b`` are gone ten hours later, those of ``a`` are not."""
    from tidelog.streaming.context import context_stream, lists_in_state

    for n, rows in enumerate(([(1, 0, "a"), (2, 0, "b")], [(3, 9, "a")], [(4, 10, "a")], [(5, 10, "b")])):
        _land_context(tmp_path, n, rows)
    stream = spark.readStream.schema(CONTEXT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with lists_in_state(spark):
        query = context_stream(stream, "k", "m", keep_hours=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["id"]: r["context"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == got[2] == got[5] == [] and got[4][-1] == "m3"


def test_context_by_batches_carries_one_row_a_key(spark, tmp_path):
    """Six pulls, one key with most rows: as over the whole table; silent keys end, a repeated batch changes nothing."""
    import os
    import random

    from tidelog.streaming.context import start_context

    rng = random.Random(3)
    rows = [(i, i // 10, "hot" if i % 3 else rng.choice([None, "x", "y"])) for i in range(60)]

    def run():
        stream = spark.readStream.schema(CONTEXT).json(str(tmp_path / "in"))
        start_context(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "m", n=2, keep_hours=48, block=4).awaitTermination()

    for n in range(6):
        _land_context(tmp_path, n, rows[10 * n : 10 * n + 10])
        run()
    want, seen = {}, {}
    for i, _, k in rows:
        want[i] = seen.get(k, [])[-2:]
        seen.setdefault(k, []).append(f"m{i}")
    got = lambda: {r["id"]: r["context"] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    assert got() == want
    state = spark.read.parquet(str(tmp_path / "out" / "last" / "1")).collect()
    assert {r["k"]: r["last"] for r in state} == {k: v[-2:] for k, v in seen.items()}
    for name in ("5", ".5.crc"):
        os.remove(tmp_path / "cp" / "commits" / name)
    run()
    assert got() == want and spark.read.parquet(str(tmp_path / "out" / "last" / "1")).count() == len(seen)
    write(tmp_path / "in" / "9.json", [{"id": 99, "ts": "2024-02-01T00:00:00Z", "k": "new", "m": "m99"}])
    run()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out" / "last" / "0")).collect()] == ["new"]
