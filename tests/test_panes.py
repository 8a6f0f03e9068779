"""Windows from panes: late rows, bounded state, repeated batches."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.streaming import panes

START = dt.datetime(2024, 3, 1)
COLUMNS = "id bigint, ts timestamp, predicted_label string, platform string, service string"


def pulls():
    """Five pulls of rows whose times scatter over more than the delay, some without a time."""
    rng = random.Random(6)
    made = []
    for pull in range(5):
        rows = []
        for k in range(80):
            ts = START + dt.timedelta(minutes=400 * pull + rng.randint(0, 400) - (rng.randint(0, 900) if k % 5 == 0 else 0), seconds=rng.randint(0, 59))
            rows.append((100 * pull + k, None if k % 20 == 19 else ts, "error" if k % 3 else "noise", "esxi", "s"))
        made.append(rows)
    return made


def expected(made, width=120, slide=15, delay=180):
    """(late, windows) row by row."""
    mark, late, counted = None, [], []
    for pull, rows in enumerate(made):
        for i, ts, label, *_ in rows:
            if ts is None:
                late.append((i, pull, "untimed"))
                continue
            pane = START + dt.timedelta(minutes=(ts - START) // dt.timedelta(minutes=slide) * slide)
            if mark is not None and pane + dt.timedelta(minutes=slide) <= mark:
                late.append((i, pull, "late"))
            else:
                counted.append((pane, label))
        times = [r[1] for r in rows if r[1] is not None]
        mark = max([m for m in (mark, max(times) - dt.timedelta(minutes=delay) if times else None) if m is not None], default=None)
    found = Counter()
    for pane, label in counted:
        for back in range(width // slide):
            w = pane - dt.timedelta(minutes=back * slide)
            if w + dt.timedelta(minutes=width) <= mark:
                found.update([(w, "total", ""), (w, "label", label), (w, "platform", "esxi")])
    return late, found


def land(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.mode("append").parquet(folder)


def run(spark, out, width=120):
    stream = spark.readStream.schema(COLUMNS).parquet(f"{out}/landed")
    panes.start_panes(stream, out, f"{out}/checkpoint", width_minutes=width).awaitTermination()


def result(spark, out):
    late = [(r["id"], r["batch_id"], r["reason"]) for r in spark.read.parquet(f"{out}/late").collect()]
    rows = spark.read.parquet(f"{out}/windows").collect()
    assert len({(r["w"], r["dimension"], r["key"]) for r in rows}) == len(rows)
    return sorted(late), {(r["w"], r["dimension"], r["key"]): r["n"] for r in rows}


def test_every_row_is_in_its_windows_or_among_the_late_ones(spark, tmp_path):
    made, out = pulls(), str(tmp_path)
    for k, rows in enumerate(made):
        land(spark, f"{out}/landed", rows)
        run(spark, out)
        run(spark, out)  # nothing new
        late, windows = expected(made[: k + 1])
        assert result(spark, out) == (sorted(late), dict(windows))
        state = spark.read.parquet(f"{out}/state/{k % 2}")
        # Three keys at most a pane, and panes of the width, the delay and one pull.
        assert state.count() <= 4 * (120 + 180 + 400) / 15
    marks = spark.read.parquet(f"{out}/marks").collect()
    assert [sum(r[c] for r in marks) for c in ("n_rows", "n_late", "n_untimed")] == [400, sum(r[2] == "late" for r in late), 20]


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    made, out = pulls()[:3], str(tmp_path)
    for rows in made:
        land(spark, f"{out}/landed", rows)
        run(spark, out)
    before = result(spark, out)
    for name in ("2", ".2.crc"):  # as if the job had died after its writes
        os.remove(f"{out}/checkpoint/commits/{name}")
    run(spark, out)
    assert result(spark, out) == before


def test_late_rows_are_those_that_the_windows_of_spark_drop(spark, tmp_path):
    """Tumbling windows keyed by row, so that a dropped row of state is one row of the input."""
    out, dropped = str(tmp_path), 0
    for rows in pulls():
        land(spark, f"{out}/landed", rows)
        run(spark, out, width=15)
        stream = spark.readStream.schema(COLUMNS).parquet(f"{out}/landed").withWatermark("ts", "180 minutes")
        counted = stream.groupBy(F.window("ts", "15 minutes"), "id").count()
        query = counted.writeStream.format("noop").option("checkpointLocation", f"{out}/own").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
    late = spark.read.parquet(f"{out}/late").filter("reason = 'late'").count()
    assert late == dropped > 0


def test_no_rows_and_only_rows_without_time(spark, tmp_path):
    out = str(tmp_path)
    land(spark, f"{out}/landed", [])
    run(spark, out)
    land(spark, f"{out}/landed", [(1, None, "noise", None, None)])
    run(spark, out)
    late, windows = result(spark, out)
    assert [r[0::2] for r in late] == [(1, "untimed")] and windows == {}


def test_a_width_of_part_slides_is_refused(spark):
    with pytest.raises(ValueError):
        panes.start_panes(None, "", "", width_minutes=20)
