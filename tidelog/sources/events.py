"""Event files: raw vendor envelopes, normalized events, predictions, and the run time in a file name."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import fixed_values as V
from tidelog.schemas import EVENT, RAW_ENVELOPE

_CORRUPT = "_corrupt_record"


def read_events(spark: SparkSession, path: str, strict: bool = True, schema: T.StructType = EVENT) -> DataFrame:
    """JSON Lines with a declared schema. ``strict`` fails on a bad line, otherwise bad lines drop out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    marked = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    # The raw text of bad lines needs its own pass over the parsed columns, hence the explicit mode.
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    return rows.json(path).filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_ENVELOPE).json(path)


def flatten_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row (_id, message, ...) per message of an envelope; missing lists give none."""
    others = [c for c in envelopes.columns if c != "messages"]
    return envelopes.select(*others, F.inline("messages"))


def run_time(file_name: Column, prefix: str) -> Column:
    """Time of the run from "<prefix>_yyyyMMddTHHmmssZ.<suffix>"; null where the name does not parse."""
    stamp = F.regexp_extract(file_name, rf"^{prefix}_(\d{{8}}T\d{{6}}Z)\.[a-z]+$", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(V.RUN_TS_FORMAT))


def with_run_time(rows: DataFrame, prefix: str) -> DataFrame:
    """Add ``run_ts`` from the file of each row; files with other names are ignored."""
    named = rows.select("*", run_time(F.col("_metadata.file_name"), prefix).alias("run_ts"))
    return named.filter(F.col("run_ts").isNotNull())
