"""Streaming form of collect, score and alert.

``foreachBatch`` handles each micro-batch with the batch operators. Its writes replace the partition
of the batch id, so a retried batch leaves the same rows as one that ran once.
"""

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidelog.operators.collect import first_by_id, normalize_events
from tidelog.operators.incidents import alerts
from tidelog.operators.selection import incidents
from tidelog.sources.events import flatten_envelopes

PULL_RANGE = "3 hours"  # runs overlap by this much, so copies and late rows come within it
DAY = "event_day"  # partition of predictions below their batch; null for rows without a time
NAMED_DAYS = 1_000  # days of one batch up to which earlier days are read by name


def envelope_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Envelope files as they land. ``platform`` is expected as a partition directory or column."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def event_stream(envelopes: DataFrame, host_pattern: str) -> DataFrame:
    return normalize_events(flatten_envelopes(envelopes), host_pattern)


def dedupe_stream(events: DataFrame, ts: str = "timestamp", delay: str = PULL_RANGE) -> DataFrame:
    """First row per id; state is kept for as long as copies can arrive. Rows without an id all stay.

    Those rows get no watermark of their own: one that never sees a row would hold back the other, as
    the lowest counts, and state would never be dropped.
    """
    with_id = events.filter(F.col("id").isNotNull())
    once = with_id.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])
    return once.unionByName(events.filter(F.col("id").isNull()))


def _replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def start_scoring(
    events: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    trigger: dict = {"availableNow": True},
) -> StreamingQuery:
    """Per micro-batch: copies inside the batch and ids of earlier batches go, the rest is scored and
    written; incidents of the batch become alert rows.

    Copies are counted down before they are shuffled, so one id that fills a third of a batch is no
    hot spot; a keyed state operator would receive all of its rows. Predictions lie by batch and day of
    the event, so looking for earlier copies reads the days the batch has rows of, not all that was
    ever written. Columns named ``batch_id`` or ``event_day`` are made here; ``score`` keeps id and timestamp.
    """
    predictions, alert_path = f"{out}/predictions", f"{out}/alerts"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        unique = first_by_id(batch, ["id"], [F.asc("timestamp"), F.asc("platform")])
        if batch_id > 0:
            unique = unique.join(_earlier_ids(batch, predictions, batch_id), "id", "left_anti")
        scored = score(unique)
        scored.withColumn(DAY, F.to_date("timestamp")).write.mode("overwrite").partitionBy(DAY).parquet(f"{predictions}/batch_id={batch_id}")
        written = spark.read.schema(scored.schema).parquet(f"{predictions}/batch_id={batch_id}").withColumn("batch_id", F.lit(batch_id))
        found = incidents(written).withColumnRenamed("timestamp", "ts")
        _replace_batch(alerts(found, ["batch_id"]).drop("batch_id"), alert_path, batch_id)

    return (
        events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _earlier_ids(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Ids of earlier batches that the batch may bring again: of the days of its rows, a day either side, or without a time.

    A single row from long ago adds its own days only. With more days than ``NAMED_DAYS`` all are read."""
    timed = batch.filter(F.col("timestamp").isNotNull()).select(F.to_date("timestamp").alias("d"))
    days = [r["d"] for r in timed.distinct().limit(NAMED_DAYS + 1).collect()]
    schema = StructType(batch.select("id", "timestamp").schema.fields).add("batch_id", "integer").add(DAY, "date")
    earlier = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("batch_id") < batch_id)
    if len(days) <= NAMED_DAYS:
        near = sorted({d + timedelta(n) for d in days for n in (-1, 0, 1) if date.min < d < date.max})
        earlier = earlier.filter(F.col(DAY).isNull() | F.col(DAY).isin(near))
    return earlier.select("id").distinct()
