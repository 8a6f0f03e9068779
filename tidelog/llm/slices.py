"""Ordered work inside groups of any size: rows are dealt by ranges of (group, order), so that a large group lies in
several slices, each small enough for one task. Windows run inside a slice; what a group carries from its earlier slices
is one row per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import materialize


def in_slices(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``_slice``, growing along ``group`` and ``order``; stored, so that slices stay as they are."""
    ranged = df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    return materialize(ranged, name)


def carried(sliced: DataFrame, group: list[str], totals: dict[str, Column], carry) -> DataFrame:
    """One row per group and slice: for each total, what ``carry`` makes of those of the earlier slices."""
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*group, "_slice").agg(*[v.alias(k) for k, v in totals.items()])
    return sums.select(*group, "_slice", *[carry(k, before).alias(f"_before_{k}") for k in totals])
