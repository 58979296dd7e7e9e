"""Statistics of each row within its group: maxima, sizes, ranks, the best of the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def group_max(value: Column, key: Keys) -> Column:
    return F.max(value).over(Window.partitionBy(*_keys(key)))


def group_size(key: Keys) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*_keys(key)))


def group_rank(value: Column, key: Keys, ties: Keys) -> Column:
    """1 for the largest; equal values in the order of `ties`."""
    return F.row_number().over(Window.partitionBy(*_keys(key)).orderBy(value.desc(), *_keys(ties)))


def group_second(value: Column, key: Keys, ties: Keys) -> Column:
    """The best value among the other rows: for rows that reach the maximum the next one, -1 if alone."""
    largest = group_max(value, key)
    whole = Window.partitionBy(*_keys(key)).orderBy(value.desc(), *_keys(ties))
    whole = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close = F.abs(value - largest) <= 1e-8 + 1e-5 * F.abs(largest)
    return F.when(close, F.coalesce(F.nth_value(value, 2).over(whole), F.lit(-1.0))).otherwise(largest)


def top_rows(df: DataFrame, value: str, key: Keys, ties: Keys, k: int) -> DataFrame:
    """The k best rows of each group; Spark keeps k a group on each side of the shuffle."""
    return df.withColumn("_rank", group_rank(F.col(value), key, ties)).where(F.col("_rank") <= k).drop("_rank")
