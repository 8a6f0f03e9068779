"""Joins whose strategy follows a measured size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
HOT_KEYS = 1_000


def within(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``table`` together take at most ``max_bytes`` as text (plus 16 for each value)."""
    width = F.lit(0).cast("long")
    for c in table.columns:
        width = width + 16 + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return (table.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]) <= max_bytes


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    spread: list[str],
    weight: str,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join ``rows`` to a stored table with unique ``on`` values, where few values may make up most rows.

    A table of at most ``max_bytes`` is broadcast. Of a larger one, only the ``hot_keys`` keys with
    the highest ``weight`` (their share of ``rows``) are; rows that found their key there are spread by
    a hash of ``spread`` through the shuffle join that finds the other keys. Both ways give the same rows
    and schema: the columns of ``rows``, then those of ``table`` but ``on`` and ``weight``.
    """
    values = [c for c in table.columns if c not in (on, weight)]
    lean = table.select(on, *values)
    if within(lean, max_bytes):
        return rows.join(F.broadcast(lean), on, how).select(*rows.columns, *values)
    hot = table.orderBy(F.desc(weight), F.asc(on)).limit(hot_keys)
    hot = hot.select(F.col(on), F.struct(*values).alias("_hot"))
    first = rows.join(F.broadcast(hot), on, "left")
    # Rows that are done get keys no table row has: distinct, so they go to all tasks.
    done = F.concat(F.lit("\x00"), F.xxhash64(*spread).cast("string"))
    keyed = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(on).cast("string")).otherwise(done))
    rest = lean.select(F.col(on).cast("string").alias("_key"), F.struct(*values).alias("_rest"))
    both = keyed.join(rest, "_key", "left").withColumn("_found", F.coalesce("_hot", "_rest"))
    if how == "inner":
        both = both.filter(F.col("_found").isNotNull())
    return both.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in values])


def small_or_shuffled(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast if it takes at most ``max_bytes``, else as it is."""
    return F.broadcast(table) if within(table, max_bytes) else table
