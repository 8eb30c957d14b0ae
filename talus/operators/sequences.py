"""Rows in order within groups: differences of neighbours and gaps filled from before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_differences(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Each row's value less that of the row before in its group; null for the first."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def fill_forward(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value so far in a row's group that is not null."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
