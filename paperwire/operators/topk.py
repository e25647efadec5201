"""Limits with a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(rows: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first ``k`` rows; each task keeps ``k`` before they are merged."""
    return rows.orderBy(*order).limit(k)


def first_per_group(rows: DataFrame, k: int, group: str, *order: str | Column) -> DataFrame:
    """The first ``k`` rows of each group; each task keeps ``k`` per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
