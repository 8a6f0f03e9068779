"""Sliding windows over a stream from counts by pane, with late rows counted and kept.

A pane is one slide of event time. Rows are counted once, by pane; a window is the sum of the panes that it covers, so an event
is never copied into all windows over it (48 for twelve hours every fifteen minutes). Every micro-batch

1. takes the watermark that the batch before it left (the newest time seen less ``delay``),
2. splits off rows whose pane that watermark has closed, and rows without a time, and writes them beside the windows with
   their batch id and the reason,
3. adds the counts of the others to those of the panes that are still needed,
4. writes the windows that its own watermark closes, and keeps the panes that later windows need.

So every row is either in all windows over its time or in the table of late rows, never in some windows only. State is one row
per needed pane and key: panes of the last ``width`` and ``delay``, whatever the number of events. It lies in two tables that
batches overwrite in turn: batch n reads what batch n - 1 wrote. All writes replace what an earlier attempt of the same batch
wrote, so a batch that is repeated leaves the same rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.reports import window_stats

SLIDE_MINUTES, WIDTH_MINUTES, DELAY_MINUTES = 15, 12 * 60, 3 * 60

_STATE = "pane timestamp, dimension string, key string, n bigint"
_MARKS = "watermark timestamp, n_rows bigint, n_late bigint, n_untimed bigint"


def _minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def _floor(ts: Column, minutes: int) -> Column:
    """The start of the stretch of ``minutes`` that ``ts`` lies in; null for null."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(minutes * 60_000_000)))


def split_late(batch: DataFrame, watermark, slide_minutes: int = SLIDE_MINUTES, ts: str = "ts") -> DataFrame:
    """``batch`` with ``pane`` and ``reason``: null for rows that count, else ``late`` or ``untimed``."""
    pane = _floor(F.col(ts), slide_minutes)
    closed = pane + _minutes(slide_minutes) <= F.lit(watermark).cast("timestamp")
    return batch.withColumn("pane", pane).withColumn("reason", F.when(F.col(ts).isNull(), "untimed").when(closed, "late"))


def closing_windows(panes: DataFrame, before, after, width_minutes: int, slide_minutes: int) -> DataFrame:
    """(w, dimension, key, n): the windows that end after ``before`` and not after ``after``; ``w`` is their start."""
    step = _minutes(slide_minutes)
    first, last = F.col("pane") + step, F.least(F.col("pane") + _minutes(width_minutes), _floor(F.lit(after).cast("timestamp"), slide_minutes))
    if before is not None:
        first = F.greatest(first, _floor(F.lit(before).cast("timestamp"), slide_minutes) + step)
    ends = F.when(first <= last, F.sequence(first, last, step))
    copied = panes.withColumn("_end", F.explode(ends))
    return copied.groupBy((F.col("_end") - _minutes(width_minutes)).alias("w"), "dimension", "key").agg(F.sum("n").alias("n"))


def start_panes(
    events: DataFrame,
    out: str,
    checkpoint: str,
    count: Callable[[DataFrame], DataFrame] = lambda rows: window_stats(rows, ["pane"]),
    width_minutes: int = WIDTH_MINUTES,
    slide_minutes: int = SLIDE_MINUTES,
    delay_minutes: int = DELAY_MINUTES,
    ts: str = "ts",
    trigger: dict = {"availableNow": True},
) -> StreamingQuery:
    """Writes ``windows``, ``late`` and ``marks`` (a row per batch: its watermark and numbers of rows) below ``out``, each
    partitioned by ``batch_id``. ``count`` makes (pane, dimension, key, n) of rows with ``pane``."""
    if width_minutes % slide_minutes:
        raise ValueError("a window is a whole number of slides")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, panes = None, spark.createDataFrame([], _STATE)
        if batch_id > 0:
            before = spark.read.schema(_MARKS).parquet(f"{out}/marks/batch_id={batch_id - 1}").first()["watermark"]
            panes = spark.read.schema(_STATE).parquet(f"{out}/state/{(batch_id - 1) % 2}")
        split = split_late(batch, before, slide_minutes, ts).persist()
        summed = panes
        try:
            seen = split.agg(
                (F.max(ts) - _minutes(delay_minutes)).alias("mark"), F.count("*").alias("n_rows"),
                F.count_if(F.col("reason") == "late").alias("n_late"), F.count_if(F.col("reason") == "untimed").alias("n_untimed"),
            ).first()
            after = max((m for m in (before, seen["mark"]) if m is not None), default=None)
            split.filter("reason is not null").drop("pane").write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
            counted = count(split.filter("reason is null").drop("reason")).select("pane", "dimension", "key", "n")
            summed = panes.unionByName(counted).groupBy("pane", "dimension", "key").agg(F.sum("n").alias("n")).persist()
            closed, needed = summed.filter("false").select(F.col("pane").alias("w"), "dimension", "key", "n"), F.lit(True)
            if after is not None:
                closed = closing_windows(summed, before, after, width_minutes, slide_minutes)
                needed = F.col("pane") + _minutes(width_minutes) > F.lit(after).cast("timestamp")
            closed.write.mode("overwrite").parquet(f"{out}/windows/batch_id={batch_id}")
            summed.filter(needed).write.mode("overwrite").parquet(f"{out}/state/{batch_id % 2}")
            marks = spark.createDataFrame([(after, seen["n_rows"], seen["n_late"], seen["n_untimed"])], _MARKS)
            marks.coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")
        finally:
            split.unpersist()
            summed.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
