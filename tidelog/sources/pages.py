"""HTML files, with the platform taken from the directory below the root."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPED = [("\ue000", "\ue000a"), ("\ufffd", "\ue000b")]


def read_html(spark: SparkSession, root: str) -> DataFrame:
    """(source, platform, html) of every .html file below ``root``/<platform>/."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.html")
        .load(root)
    )
    base = root.rstrip("/").rsplit("/", 1)[-1]
    platform = F.regexp_extract("path", rf"/\Q{base}\E/([^/]+)/", 1)
    # Bytes that are not UTF-8 are left out: they become U+FFFD, from which real ones are told apart by an escape.
    html = F.col("content").cast("string")
    for sign, put in _ESCAPED:
        html = F.replace(html, F.lit(sign), F.lit(put))
    html = F.replace(F.make_valid_utf8(html), F.lit("\ufffd"), F.lit(""))
    for sign, put in reversed(_ESCAPED):
        html = F.replace(html, F.lit(put), F.lit(sign))
    return files.select(
        F.col("path").alias("source"), platform.alias("platform"), html.alias("html")
    ).filter("platform <> ''")
