"""Row selection by label, ingest time, event time and latest batch. ``now`` is always an argument."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import first_filled


def incidents(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("predicted_label").isin(V.INCIDENT_LABELS))


def ingested_since(df: DataFrame, now: Column, minutes: int = 15, run_ts: str = "run_ts") -> DataFrame:
    """Rows of runs in the last ``minutes``; prunes partitions where run_ts is the partition column."""
    return df.filter(F.col(run_ts) >= now - F.make_dt_interval(mins=F.lit(minutes)))


def occurred_since(df: DataFrame, now: Column, hours: int = 12, ts: str = "ts") -> DataFrame:
    """Rows by event time; the cutoff is cut to the whole second, missing times drop out."""
    cutoff = F.date_trunc("second", now - F.make_dt_interval(hours=F.lit(hours)))
    return df.filter(F.col(ts) >= cutoff.cast(df.schema[ts].dataType))


def latest_batch(df: DataFrame, run_ts: str = "run_ts") -> DataFrame:
    """Rows of the newest run. The scalar subquery runs first, so a run_ts partition column prunes."""
    return df.filter(F.col(run_ts) == df.agg(F.max(run_ts)).scalar())


def recent_or_latest(df: DataFrame, now: Column, minutes: int = 15, run_ts: str = "run_ts") -> DataFrame:
    """Runs of the last ``minutes``; where there is none, the newest run."""
    cutoff = now - F.make_dt_interval(mins=F.lit(minutes))
    return df.filter(F.col(run_ts) >= F.least(cutoff, df.agg(F.max(run_ts)).scalar()))


def anomalies(predictions: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    return ingested_since(incidents(predictions), now, minutes=60 * hours)


def shown_label(predicted: Column, label: Column) -> Column:
    return F.coalesce(first_filled(predicted, F.nullif(label, F.lit(""))), F.lit(V.UNKNOWN))


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill missing source, risk and label for display, where a row lacks the value."""
    return df.select(
        "id",
        F.coalesce("source", "host", F.lit(V.UNKNOWN)).alias("shown_source"),
        F.coalesce("risk_score", F.lit(0)).alias("shown_risk"),
        shown_label(F.col("predicted_label"), F.col("label")).alias("shown_label"),
    )
