"""Model quality from (true, predicted) pairs.

Everything is read from the confusion counts, a table of at most labels squared rows per model, so
the pairs are scanned once and pre-aggregated. ``keys`` names grouping columns such as the model.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import round_even
from tidelog.operators.sketches import exact_quantile


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(pairs: DataFrame, keys: list[str] = []) -> DataFrame:
    return pairs.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, keys: list[str] = []) -> DataFrame:
    """label, precision, recall, f1, support over the union of true and predicted labels."""
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
    )
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    long = counts.select(*keys, hit.alias("hit"), F.inline(sides))
    sums = long.groupBy(*keys, "label").agg(
        (F.sum("hit") / 2).alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called")
    )
    tp, support, called = F.col("tp"), F.col("support"), F.col("called")
    return sums.select(
        *keys,
        "label",
        _ratio(tp, called).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, called + support).alias("f1"),
        "support",
        "tp",
    )


def metrics_rows(pairs: DataFrame, keys: list[str] = [], digits: int | None = 4) -> DataFrame:
    """Accuracy, macro F1, weighted F1, F1 of error and of security_noise; without ``digits`` not rounded."""
    classes = per_class(confusion_counts(pairs, keys), keys)

    def f1_of(label: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("label") == label, F.col("f1"))), F.lit(0.0))

    row = classes.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        f1_of("error").alias("f1_error"),
        f1_of("security_noise").alias("f1_security_noise"),
    )
    names = ["accuracy", "macro_f1", "weighted_f1", "f1_error", "f1_security_noise"]
    if digits is None:
        return row
    return row.select(*keys, *[round_even(F.col(c), digits).alias(c) for c in names])


def confusion_matrix(pairs: DataFrame, labels: list[str], keys: list[str] = []) -> DataFrame:
    """One row per true label, one column per predicted label."""
    counts = confusion_counts(pairs, keys)
    return counts.groupBy(*keys, "y_true").pivot("y_pred", labels).agg(F.sum("n")).na.fill(0, labels)


def binary_rows(pairs: DataFrame, keys: list[str] = [], positive: int = 1, digits: int = 4) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    t, p = F.col("y_true") == positive, F.col("y_pred") == positive
    sums = pairs.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(p).alias("called"), F.count_if(t).alias("support")
    )
    return sums.select(
        *keys,
        round_even(_ratio(F.col("tp"), F.col("called")), digits).alias("p"),
        round_even(_ratio(F.col("tp"), F.col("support")), digits).alias("r"),
        round_even(_ratio(2 * F.col("tp"), F.col("called") + F.col("support")), digits).alias("f1"),
    )


def valid_pairs(pairs: DataFrame, labels: list[str] = V.LABELS) -> DataFrame:
    """Replies outside the label domain do not count."""
    return pairs.filter(F.col("y_pred").isin(labels))


def excluded_count(pairs: DataFrame, labels: list[str] = V.LABELS) -> DataFrame:
    outside = ~F.coalesce(F.col("y_pred").isin(labels), F.lit(False))
    return pairs.agg(F.count("*").alias("replies"), F.count_if(outside).alias("excluded"))


def exact_percentile(df: DataFrame, value: str, q: float, **passes: int) -> DataFrame:
    """Percentile with linear interpolation, exact, as one row (n, value); none without values.

    The rank is narrowed down by counted bins (``sketches.exact_quantile``): no task orders an unbounded number of rows.
    """
    n, found = exact_quantile(df, value, q, **passes)
    return df.sparkSession.createDataFrame([(n, found)] if n else [], "n bigint, value double")


def latency_row(df: DataFrame, seconds: str = "seconds", digits: int = 4) -> DataFrame:
    """Mean and 95th percentile of inference time."""
    n, p95 = exact_quantile(df, seconds, 0.95)
    return df.agg(F.avg(seconds).alias("mean")).filter(F.lit(n > 0)).select(
        round_even(F.col("mean"), digits).alias("mean_seconds"),
        round_even(F.lit(p95).cast("double"), digits).alias("p95_seconds"),
    )


def mark_best(rows: DataFrame, score: str = "macro_f1", seq: str = "seq") -> DataFrame:
    """Add ``best``: highest score, the earlier row on ties. A comparison table is a handful of rows."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(seq)))
    return rows.withColumn("best", rank == 1)


def with_published(rows: DataFrame) -> DataFrame:
    """Append the published sequence-model results to (model, p, r, f1) rows."""
    published = rows.sparkSession.createDataFrame(V.PUBLISHED_SESSION_RESULTS, "model string, p double, r double, f1 double")
    return rows.select("model", "p", "r", "f1").unionByName(published)


def best_own(rows: DataFrame) -> DataFrame:
    """Best row by F1 that is not a published one."""
    names = [name for name, *_ in V.PUBLISHED_SESSION_RESULTS]
    return rows.filter(~F.col("model").isin(names)).orderBy(F.desc("f1"), F.asc("model")).limit(1)


def crossval_summary(folds: DataFrame, digits: int = 4) -> DataFrame:
    """(model, fold, macro_f1) to mean, population std, mean -/+ 1.96 std and the fold list."""
    mean, std = F.avg("macro_f1"), F.stddev_pop("macro_f1")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("fold", "macro_f1"))), lambda x: round_even(x["macro_f1"], digits))
    return folds.groupBy("model").agg(
        round_even(mean, digits).alias("mean"),
        round_even(std, digits).alias("std"),
        round_even(mean - 1.96 * std, digits).alias("ci_low"),
        round_even(mean + 1.96 * std, digits).alias("ci_high"),
        listed.alias("folds"),
    )


def detail_rows(pairs: DataFrame) -> DataFrame:
    """Per-example rows of a text model: template, labels, confidence, seconds."""
    return pairs.select(
        "template",
        F.col("y_true").alias("true_label"),
        F.col("y_pred").alias("pred_label"),
        "confidence",
        F.col("seconds").alias("inference_sec"),
    )


def class_share(df: DataFrame, label: str = "label") -> DataFrame:
    per_label = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return per_label.select(label, "n", round_even(F.col("n") / total, 4).alias("share"))


def confidence_stats(df: DataFrame, confidence: str = "confidence", threshold: float = V.OOD_THRESHOLD) -> DataFrame:
    """Out-of-distribution rate in percent, mean and population std of confidence."""
    c = F.col(confidence)
    return df.agg(
        round_even(100 * F.avg((c < threshold).cast("double")), 4).alias("ood_pct"),
        round_even(F.avg(c), 4).alias("mean"),
        round_even(F.stddev_pop(c), 4).alias("std"),
    )


def confidence_histogram(df: DataFrame, bins: int = 40, confidence: str = "confidence") -> DataFrame:
    """Counts in equal bins from minimum to maximum, empty ones too; the top edge belongs to the last bin."""
    edges = df.agg(F.min(confidence).alias("_lo"), F.max(confidence).alias("_hi"))
    c, lo, hi = F.col(confidence), F.col("_lo"), F.col("_hi")
    place = F.floor(_ratio((c - lo) * bins, hi - lo)).cast("int")
    binned = df.filter(c.isNotNull()).join(F.broadcast(edges)).select(F.least(place, F.lit(bins - 1)).alias("bin"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
