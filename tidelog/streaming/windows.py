"""Event-time windows over a stream: closed windows only, after the watermark has passed them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog import fixed_values as V
from tidelog.functions.scoring import risk_score
from tidelog.operators.reports import with_report_keys
from tidelog.streaming.ingest import PULL_RANGE


def summary_windows(
    predictions: DataFrame, width: str = "12 hours", slide: str | None = None, delay: str = PULL_RANGE, ts: str = "ts"
) -> DataFrame:
    """(w, dimension, key, n) per window: the total, and the counts by label and platform.

    Three rows per event go into a pre-aggregated count; state holds a few counters per window.
    """
    pieces = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("key")),
        F.struct(F.lit("label").alias("dimension"), F.col("shown_label").alias("key")),
        F.struct(F.lit("platform").alias("dimension"), F.col("shown_platform").alias("key")),
    )
    rows = with_report_keys(predictions.withWatermark(ts, delay)).select(ts, F.inline(pieces))
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = rows.groupBy(window.alias("window"), "dimension", "key").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("w"), "dimension", "key", "n")


def severity_windows(predictions: DataFrame, width: str = "15 minutes", delay: str = PULL_RANGE, ts: str = "ts") -> DataFrame:
    """(w, n, urgent, severity, reason) per window with incidents."""
    # Counted under a condition, not filtered first: the filter would move below the watermark, and
    # windows would then stay open until the next incident.
    is_incident = F.col("predicted_label").isin(V.INCIDENT_LABELS)
    counted = (
        predictions.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("window"))
        .agg(
            F.count_if(is_incident).alias("n"),
            F.max(F.when(is_incident, risk_score(F.col("predicted_label")))).alias("top"),
        )
        .filter("n > 0")
    )
    urgent = F.col("top") >= V.P1_RISK
    return counted.select(
        F.col("window.start").alias("w"),
        "n",
        urgent.alias("urgent"),
        F.when(urgent, "P1").otherwise("P3").alias("severity"),
        F.format_string("rule-based: %d anomalies", F.col("n")).alias("reason"),
    )


def start_table(rows: DataFrame, path: str, checkpoint: str, trigger: dict = {"availableNow": True}) -> StreamingQuery:
    """Append closed windows to a Parquet table."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
