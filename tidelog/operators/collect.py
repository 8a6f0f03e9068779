"""Raw messages to normalized events: projection, search over landed data, duplicate removal."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.rewrites import mask_hosts, template_of
from tidelog.functions.tagging import event_type_of, service_of
from tidelog.functions.text import first_filled


def message_id(message: str = "message", outer_id: str = "_id") -> Column:
    """gl2_message_id, else the inner id, else the outer id; empty text counts as missing."""
    return first_filled(F.col(f"{message}.gl2_message_id"), F.col(f"{message}._id"), F.col(outer_id))


def normalize_events(raw: DataFrame, host_pattern: str) -> DataFrame:
    """Envelope rows (_id, message struct, platform, ...) to the 13 event columns.

    Further columns of ``raw``, such as run_ts, are kept.
    """
    m = F.col("message")
    text = F.coalesce(m["message"], F.lit(""))
    kept = [c for c in raw.columns if c not in ("_id", "message", "platform")]
    return raw.select(
        message_id().alias("id"),
        F.try_to_timestamp(m["timestamp"]).alias("timestamp"),
        "platform",
        mask_hosts(F.coalesce(m["source"], F.lit("")), host_pattern).alias("host"),
        F.lit(None).cast("string").alias("cluster"),
        m["source"].alias("source"),
        service_of(text).alias("service"),
        m["level"].alias("severity"),
        m["facility"].alias("facility"),
        text.alias("message"),
        template_of(text, host_pattern).alias("template"),
        event_type_of(text).alias("event_type"),
        F.lit(None).cast("string").alias("label"),
        *kept,
    )


def search(
    raw: DataFrame,
    predicate: Column,
    now: Column,
    range_seconds: int = 900,
    limit: int = 10_000,
    fields: list[str] | None = None,
    ts: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """Newest ``limit`` rows of a relative time range: a top-k, not a full sort."""
    start = now - F.make_dt_interval(secs=F.lit(range_seconds))
    hits = raw.filter(predicate & (F.col(ts) >= start) & (F.col(ts) <= now))
    return hits.orderBy(F.desc(ts), F.asc(tie)).limit(limit).select(*(fields or raw.columns))


def first_by_id(events: DataFrame, keys: list[str], order: list[Column], keep_null_ids: bool = True) -> DataFrame:
    """One row per key, the first in ``order``. ``keys`` = ["run_ts", "id"] limits it to a run.

    ``row_number() = 1`` is planned with a limit before the shuffle, so of a heavily copied id
    every task sends one row. Rows without an id are kept unless parity with a set of seen ids,
    where null is a value like any other, is asked for.
    """
    from pyspark.sql import Window

    if keep_null_ids:
        id_key = keys[-1]
        with_id = events.filter(F.col(id_key).isNotNull())
        without = events.filter(F.col(id_key).isNull())
        return first_by_id(with_id, keys, order, keep_null_ids=False).unionByName(without)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def collection_stats(raw: DataFrame, unique: DataFrame) -> DataFrame:
    """Per platform: rows pulled and rows left after duplicate removal."""
    collected = raw.groupBy("platform").agg(F.count("*").alias("collected"))
    kept = unique.groupBy("platform").agg(F.count("*").alias("kept"))
    return collected.join(kept, "platform", "left").select(
        "platform", "collected", F.coalesce("kept", F.lit(0)).alias("unique")
    )
