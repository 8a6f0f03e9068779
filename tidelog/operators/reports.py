"""Window statistics and the Markdown summary."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import cut
from tidelog.operators.selection import incidents, shown_label

_UNKNOWN = "unknown"


def with_report_keys(events: DataFrame) -> DataFrame:
    """Columns the counters use: label with its fallbacks, platform and service with defaults."""
    label = F.col("label") if "label" in events.columns else F.lit(None).cast("string")
    return events.select(
        "*",
        shown_label(F.col("predicted_label"), label).alias("shown_label"),
        F.coalesce("platform", F.lit(_UNKNOWN)).alias("shown_platform"),
        F.coalesce("service", F.lit(_UNKNOWN)).alias("shown_service"),
    )


def _pre_counted(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per (keys, label, platform, service): every counter below folds this small table."""
    dims = ["shown_label", "shown_platform", "shown_service"]
    return with_report_keys(events).groupBy(*keys, *dims).agg(F.count("*").alias("n"))


def window_stats(events: DataFrame, keys: list[str] = []) -> DataFrame:
    """Tidy rows (dimension, key, n): the total, and the counts by label and by platform."""
    pieces = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("key")),
        F.struct(F.lit("label").alias("dimension"), F.col("shown_label").alias("key")),
        F.struct(F.lit("platform").alias("dimension"), F.col("shown_platform").alias("key")),
    )
    long = _pre_counted(events, keys).select(*keys, "n", F.inline(pieces))
    return long.groupBy(*keys, "dimension", "key").agg(F.sum("n").alias("n"))


def rolling_stats(events: DataFrame, width_minutes: int, slide_minutes: int, ts: str = "ts") -> DataFrame:
    """window_stats of every sliding window; ``w`` is the window start.

    Rows are counted once per slide; only the counts are copied into the windows that cover them.
    """
    slide = F.window(ts, f"{slide_minutes} minutes")["start"]
    per_slide = window_stats(events.withColumn("_slide", slide), ["_slide"])
    steps = F.explode(F.sequence(F.lit(0), F.lit(width_minutes // slide_minutes - 1))).alias("_back")
    copied = per_slide.select("_slide", "dimension", "key", "n", steps)
    start = F.col("_slide") - F.make_dt_interval(mins=F.col("_back") * slide_minutes)
    return copied.groupBy(start.alias("w"), "dimension", "key").agg(F.sum("n").alias("n"))


def top_services(events: DataFrame, keys: list[str] = [], n: int = 5) -> DataFrame:
    counts = (
        _pre_counted(events, keys)
        .groupBy(*keys, F.col("shown_service").alias("service"))
        .agg(F.sum("n").alias("n"))
    )
    order = [F.desc("n"), F.asc("service")]
    if not keys:
        return counts.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def top_errors(events: DataFrame, keys: list[str] = [], n: int = 5) -> DataFrame:
    """Distinct error templates in order of first sight, each with the host and text of its last event."""
    seen = F.struct("run_ts", "ts", "id")
    host = F.coalesce(*[c for c in ("source", "host") if c in events.columns]).alias("host")
    rows = (
        incidents(events)
        .groupBy(*keys, "template")
        .agg(
            F.min(seen).alias("first_seen"),
            F.max_by(F.struct(host, "message"), seen).alias("last"),
        )
        .select(
            *keys,
            "first_seen",
            F.coalesce("last.host", F.lit(_UNKNOWN)).alias("host"),
            cut(F.col("template"), 150).alias("template"),
            cut(F.coalesce("last.message", F.lit("")), 100).alias("message"),
        )
    )
    if not keys:
        return rows.orderBy("first_seen", "template").limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("first_seen", "template"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def _list_text(rows: DataFrame, keys: list[str], line: Column, order: list[Column], name: str) -> DataFrame:
    """Rows of a group joined to text in the given order. Groups are small: labels, platforms, five errors."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias(name))


def report_parts(events: DataFrame, period: str) -> DataFrame:
    """(period, total_events, labels, platforms, errors): the counters and errors as bullet text."""
    keys = [period]
    stats = window_stats(events, keys)
    counted = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("n").cast("string"))
    order = [(-F.col("n")).alias("o1"), F.col("key").alias("o2")]
    totals = stats.filter("dimension = 'total'").select(period, F.col("n").alias("total_events"))
    labels = _list_text(stats.filter("dimension = 'label'"), keys, counted, order, "labels")
    platforms = _list_text(stats.filter("dimension = 'platform'"), keys, counted, order, "platforms")
    error_line = F.concat(F.lit("- "), cut(F.col("template"), 100))
    errors = _list_text(top_errors(events, keys), keys, error_line, [F.col("first_seen")], "errors")
    return totals.join(labels, period).join(platforms, period).join(errors, period, "left")


def markdown_report(events: DataFrame, period: str) -> DataFrame:
    """One Markdown text per value of the column ``period``."""
    period_text = F.col(period).cast("string")
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("# Log report "), period_text),
        F.lit("\n## Volume"),
        F.concat(F.lit("Events: "), F.col("total_events")),
        F.lit("\n## Labels"),
        F.col("labels"),
        F.lit("\n## First errors"),
        F.coalesce("errors", F.lit("")),
        F.lit("\n## By platform"),
        F.col("platforms"),
    )
    return report_parts(events, period).select(period, "total_events", content.alias("content"))


def latest_report(reports: DataFrame) -> DataFrame:
    """The report with the highest period."""
    return reports.agg(F.max("period").alias("period"), F.max_by("content", "period").alias("content"))
