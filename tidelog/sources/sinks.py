"""Writers. Runs are partitions, so a repeated run replaces its own rows and nothing else."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.joins import small_or_shuffled
from tidelog.schemas import LABELED_TEMPLATE, REVIEW_CANDIDATE


def write_raw(envelopes: DataFrame, path: str) -> None:
    """Audit copy of what was pulled: JSON by platform and run. A repeated run replaces its own rows."""
    _replace(envelopes, ["platform", "run_ts"], path, "json")


def _replace(rows: DataFrame, by: list[str], path: str, form: str) -> None:
    """Write the partitions present in ``rows`` anew and leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)


def write_runs(rows: DataFrame, path: str) -> None:
    """Events or predictions as Parquet by run; only the runs present in ``rows`` are replaced."""
    _replace(rows, ["run_ts"], path, "parquet")


def pending_runs(events: DataFrame, scored: DataFrame) -> DataFrame:
    """Events of runs that have no predictions yet."""
    done = small_or_shuffled(scored.select("run_ts").distinct())
    return events.join(done, "run_ts", "left_anti")


def _write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    ordered = rows.select(*columns).orderBy(F.desc("count"), F.asc("template"))
    ordered.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_labels(templates: DataFrame, path: str) -> None:
    _write_csv(templates, LABELED_TEMPLATE.fieldNames(), path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    _write_csv(candidates, REVIEW_CANDIDATE.fieldNames(), path)


def write_vectors(chunks: DataFrame, path: str) -> None:
    """The whole vector table anew: id (source and chunk number, so that no two chunks share one), vector and payload."""
    key = F.concat_ws("#", "source", F.col("chunk_id").cast("string")).alias("id")
    chunks.select(key, "vector", "text", "source", "platform", "chunk_id").write.mode("overwrite").parquet(path)


def write_evaluation(
    folder: str,
    run_id: str,
    summary: DataFrame,
    crossval: DataFrame | None = None,
    details: DataFrame | None = None,
    args: dict[str, str] | None = None,
) -> None:
    """Summary as CSV, folds, details and run settings as JSON, all by run."""

    def put(rows: DataFrame, name: str, form: str) -> None:
        out = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("run_id").option("header", "true").format(form).save(f"{folder}/{name}")

    put(summary, "summary", "csv")
    if crossval is not None:
        put(crossval, "crossval", "json")
    if details is not None:
        put(details, "details", "json")
    settings = sorted((args or {}).items())
    put(summary.sparkSession.createDataFrame(settings or [("none", "")], "name string, value string"), "run_meta", "json")


def write_reports(reports: DataFrame, path: str) -> None:
    """(period, content): a period is replaced when it is written again."""
    _replace(reports.select("period", "content"), ["period"], path, "parquet")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("content string, period string").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """JSON by run and channel; a repeated run replaces its own alerts."""
    _replace(alerts, ["run_ts", "channel"], path, "json")
