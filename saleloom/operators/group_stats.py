"""Attach per-group figures to rows without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a one-row-per-key table onto rows of any skew.

    Adaptive execution broadcasts the table where it turns out small and splits the
    partitions of a busy key where it does not.
    """
    return df.join(table, keys, "left")


def attach_aggregates(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Group figures (map-side combined) joined back onto the rows."""
    return attach(df, df.groupBy(*keys).agg(*aggregates), keys)


def lookup_or_default(df: DataFrame, table: DataFrame, keys: list[str], value: str,
                      default: Column) -> DataFrame:
    """``attach`` and fill keys the table does not know."""
    return attach(df, table, keys).withColumn(value, F.coalesce(F.col(value), default))
