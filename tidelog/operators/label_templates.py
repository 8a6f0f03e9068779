"""Labeled template table: rule labels, per-template counts, conflict resolution, review candidates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.labeling import review_reason, weak_label
from tidelog.functions.rewrites import second_pass
from tidelog.functions.text import round_even

DIMENSIONS = ["label", "event_type", "service", "platform"]
_ALL_LABELS = V.LABELS + [V.UNKNOWN]


def _has_text(template: Column) -> Column:
    return F.coalesce(template, F.lit("")).rlike(r"(?U)\S")


def _with_label(rows: DataFrame, second: bool, label_on: str) -> DataFrame:
    first = F.col("template")
    text = first if label_on == "raw" else F.col("_second")
    return (
        rows.withColumn("_second", second_pass(first) if second else first)
        .withColumn("label", weak_label(text, F.col("event_type"), F.col("service")))
        .withColumn("template", F.col("_second"))
        .drop("_second")
    )


def label_events(events: DataFrame, second: bool = True, label_on: str = "template") -> DataFrame:
    """Add ``label`` to every event; ``template`` gets the second pass. Blank templates drop out.

    ``label_on="raw"`` labels the text before the second pass hides login and logout.
    """
    # Spark moves no filter below a generator: as a plain one it would run the rewrite chain a second time, and before any
    # repartition of the events.
    whole = events.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in events.columns]))))
    return _with_label(whole.filter(_has_text(F.col("template"))), second, label_on)


def template_counts(events: DataFrame, second: bool = True, label_on: str = "template") -> DataFrame:
    """One row per distinct (template, label, event type, service, platform) with its count.

    Events are first counted by their collected template. That is the only shuffle of event-sized
    data, and it counts before the shuffle: a template that holds a third of all rows arrives as one
    row per task. The second pass and the label rules then run once per distinct template, and a
    small second count folds what the second pass made equal. Blank templates count zero, so the
    check for them stays above the aggregate and the rewrite chain is not run twice for it.
    """
    tags = ["event_type", "service", "platform"]
    counted = (
        events.select("template", *[F.coalesce(c, F.lit("")).alias(c) for c in tags])
        .groupBy("template", *tags)
        .agg(F.count(F.when(_has_text(F.col("template")), 1)).alias("n"))
        .filter("n > 0")
    )
    return (
        _with_label(counted, second, label_on)
        .groupBy("template", *DIMENSIONS)
        .agg(F.sum("n").alias("n"))
    )


def _most_common(dimension: str) -> Column:
    """Highest count, then lowest value."""
    key = F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value"))
    return F.min(F.when(F.col("dimension") == dimension, key))["value"]


def _label_count(label: str) -> Column:
    return F.sum(F.when((F.col("dimension") == "label") & (F.col("value") == label), F.col("n")))


def label_templates(counts: DataFrame, min_share: float = V.MIN_LABEL_SHARE) -> DataFrame:
    """Template table from ``template_counts``: resolved label, most common tags, count, confidence.

    The four tag counters of a template are unpivoted, so one grouping serves them all.
    """
    long = counts.unpivot(["template", "n"], DIMENSIONS, "dimension", "value")
    per_value = long.groupBy("template", "dimension", "value").agg(F.sum("n").alias("n"))
    per_template = per_value.groupBy("template").agg(
        *[_most_common(d).alias(d) for d in DIMENSIONS],
        *[_label_count(x).alias(f"_{x}") for x in _ALL_LABELS],
        F.sum(F.when(F.col("dimension") == "label", F.col("n"))).alias("count"),
    )
    label_counts = [F.col(f"_{x}") for x in _ALL_LABELS]
    share = F.greatest(*label_counts) / F.col("count")
    kinds = sum((c.isNotNull().cast("int") for c in label_counts), F.lit(0))
    resolved = F.when((kinds > 1) & (share < min_share), V.UNKNOWN).otherwise(F.col("label"))
    parts = [
        F.when(F.col(f"_{x}").isNotNull(), F.format_string(f'"{x}": %d', F.col(f"_{x}")))
        for x in sorted(_ALL_LABELS)
    ]
    return per_template.select(
        "template",
        resolved.alias("label"),
        "event_type",
        "service",
        "platform",
        "count",
        round_even(share, 3).alias("label_confidence"),
        F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("label_candidates"),
    )


def review_candidates(templates: DataFrame) -> DataFrame:
    """Templates with a reason for a human look."""
    reason = review_reason(F.col("template"), F.col("event_type"), F.col("service"))
    return (
        templates.withColumnRenamed("label", "suggested_label")
        .withColumn("reason", reason)
        .filter("reason <> ''")
        .select(
            "template", "suggested_label", "reason", "event_type", "service", "platform", "count",
            "label_confidence", "label_candidates",
        )
    )


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label and their percentage, one decimal."""
    per_label = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return per_label.select(label, "n", round_even(100 * F.col("n") / total, 1).alias("pct"))


def first_per_label(rows: DataFrame, order: list[Column], n: int = 3, label: str = "label") -> DataFrame:
    """First ``n`` rows per label; the limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def template_dictionary(counts: DataFrame) -> DataFrame:
    """Distinct templates with their support, from ``template_counts``."""
    return counts.groupBy("template").agg(F.sum("n").alias("support"))
