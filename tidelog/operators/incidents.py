"""Incident triage: last row per template, top by risk, severity, routing, alert text.

Groups may be hot (one window, one template). Ranks with a small limit are cut before the shuffle,
counts are pre-aggregated, and host lists are taken from the distinct hosts, three per group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import cut

_HOSTS_SHOWN = 3


def _newest_first() -> list[Column]:
    return [F.desc("run_ts"), F.desc("ts"), F.desc("id")]


def _riskiest_first() -> list[Column]:
    return [F.desc("risk_score"), F.asc("ts"), F.asc("id")]


def _first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def last_per_template(events: DataFrame, keys: list[str] = ["template"]) -> DataFrame:
    """The newest event of each template."""
    return _first_n(events, keys, _newest_first(), 1).drop("rank")


def top_by_risk(events: DataFrame, n: int, tie: list[str] = ["template"]) -> DataFrame:
    return events.orderBy(F.desc("risk_score"), *[F.asc(t) for t in tie]).limit(n)


def bullet_lines(
    events: DataFrame,
    keys: list[str],
    n: int,
    chars: int,
    missing: str = V.UNKNOWN,
    line_format: str = "- [%s] %s",
    name: str = "lines",
) -> DataFrame:
    """The ``n`` riskiest events per group as one text of bullet lines; ``n`` bounds the list."""
    line = F.format_string(line_format, F.coalesce("source", F.lit(missing)), cut(F.col("template"), chars))
    top = _first_n(events, keys, _riskiest_first(), n).select(*keys, "rank", line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return top.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias(name))


def prompt_lines(events: DataFrame, keys: list[str]) -> DataFrame:
    """Top five for a severity prompt."""
    return bullet_lines(events, keys, 5, 120)


def alert_lines(events: DataFrame, keys: list[str]) -> DataFrame:
    """Top three for an urgent alert."""
    return bullet_lines(events, keys, 3, 80, missing="?", line_format="• `%s` %s", name="top_lines")


def assess(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rule severity per group: any risk of 15 or more is P1 and urgent, else P3."""
    totals = events.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.col("risk_score") >= V.P1_RISK), F.lit(False)).alias("urgent"),
    )
    hosts = events.select(*keys, F.coalesce("source", F.lit("?")).alias("host")).distinct()
    shown = _first_n(hosts, keys, [F.asc("host")], _HOSTS_SHOWN)
    shown = shown.groupBy(*keys).agg(F.array_sort(F.collect_list("host")).alias("affected_hosts"))
    return totals.join(shown, keys).select(
        *keys,
        "n",
        "urgent",
        F.when(F.col("urgent"), "P1").otherwise("P3").alias("severity"),
        F.format_string("rule-based: %d anomalies", F.col("n")).alias("reason"),
        "affected_hosts",
    )


def assess_all(events: DataFrame) -> DataFrame:
    """One row for the whole input; the P4 row where there is no event."""
    found = assess(events.withColumn("_all", F.lit(1)), ["_all"])
    one = events.sparkSession.range(1).select(F.lit(1).alias("_all"))
    return one.join(found, "_all", "left").select(
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("urgent", F.lit(False)).alias("urgent"),
        F.coalesce("severity", F.lit("P4")).alias("severity"),
        F.coalesce("reason", F.lit("No anomalies detected")).alias("reason"),
        F.coalesce("affected_hosts", F.array().cast("array<string>")).alias("affected_hosts"),
    )


def route(assessed: DataFrame, urgent: str = "urgent", daily: str = "daily") -> DataFrame:
    """Name the channel. Groups without events leave no row, so nothing is sent for them."""
    return assessed.filter("n > 0").withColumn("channel", F.when(F.col("urgent"), urgent).otherwise(daily))


def alerts(events: DataFrame, keys: list[str], at: Column | None = None) -> DataFrame:
    """Alert rows per group: channel, severity, count, hosts, reason, text. A sink partitions by channel."""
    routed = route(assess(events, keys)).join(alert_lines(events, keys), keys)
    hosts = F.coalesce(F.nullif(F.array_join("affected_hosts", ", "), F.lit("")), F.lit(V.UNKNOWN))
    time_line = [] if at is None else [F.concat(F.lit("Time: "), F.date_format(at, "HH:mm 'UTC'"))]
    urgent_text = F.concat_ws(
        "\n",
        F.concat(F.col("severity"), F.lit(": "), F.col("n"), F.lit(" anomalous events")),
        F.concat(F.lit("Hosts: "), hosts),
        F.concat(F.lit("Why: "), F.col("reason")),
        *time_line,
        F.lit("Highest risk first:"),
        F.col("top_lines"),
    )
    daily_text = F.format_string("%d errors or anomalies, none urgent: %s", F.col("n"), F.col("reason"))
    return routed.select(
        *keys,
        "channel",
        "severity",
        "n",
        hosts.alias("hosts"),
        "reason",
        F.when(F.col("urgent"), urgent_text).otherwise(daily_text).alias("text"),
    )
