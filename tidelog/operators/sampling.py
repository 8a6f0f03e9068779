"""Seeded splits, folds and samples. Order comes from an md5 of seed and key, so every engine agrees."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def rank_within_label(
    df: DataFrame, key: str, label: str = "label", seed: int = 42, slice_digits: int = 3
) -> DataFrame:
    """Add ``position`` (1-based, by seeded hash) and ``label_rows`` per label.

    One label may hold most rows, so ranking runs per (label, leading hash digits): even slices of
    every label. Counts per slice, a small table, give the start of each slice.
    """
    hashed = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_s", F.substring("_h", 1, slice_digits))
    sizes = hashed.groupBy(label, "_s").agg(F.count("*").alias("_n"))
    in_label = Window.partitionBy(label)
    before = in_label.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(label).alias("_l"),
        F.col("_s").alias("_ss"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(in_label).alias("label_rows"),
    )
    in_slice = F.row_number().over(Window.partitionBy(label, "_s").orderBy("_h", key))
    joined = hashed.withColumn("_r", in_slice).join(
        starts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_ss"))
    )
    return joined.withColumn("position", F.col("_start") + F.col("_r")).drop("_h", "_s", "_l", "_ss", "_start", "_r")


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``: "test" for the first ceil(share * n) rows of each label, else "train"."""
    ranked = rank_within_label(df, key, label, seed)
    is_test = F.col("position") <= F.ceil(F.col("label_rows") * F.lit(test_share))
    return ranked.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("position", "label_rows")


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1; every label is spread evenly over the folds."""
    ranked = rank_within_label(df, key, label, seed)
    return ranked.withColumn("fold", (F.col("position") - 1) % k).drop("position", "label_rows")


def per_class_sample(
    df: DataFrame, key: str, limit: int, classes: int, label: str = "label", seed: int = 42
) -> DataFrame:
    """max(1, limit // classes) rows per label, fewer where a label is smaller."""
    n = max(1, limit // classes)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(seeded_hash(key, seed), key))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows: a top-k by seeded hash."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
