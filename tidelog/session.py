"""Session helpers: the shared folder for lineage cuts and streaming state, and size-checked joins."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitting job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidelog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where the setting is absent (tests on one machine) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that outlives executors.

    The shuffles of the write are done with when it ends, so their files go then and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again: neither a later step nor the result."""
    for table in tables:
        jvm, files = table.sparkSession.sparkContext._jvm, table.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


ROWS_A_TASK = 200_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows over all cores where a small input arrives in fewer splits than there are cores.

    For sources of CPU-heavy work only. Large inputs have more splits than cores and stay as they are, unless ``rows`` says how many a
    task may take: packed files hold millions of short rows in a split. ``df`` is counted then, so it should be a plain read.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        least = max(least, -(-df.count() // rows))
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df
