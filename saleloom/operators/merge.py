"""Union, duplicate handling and recent-row selection on the panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleloom.schema import CATEGORY, DATE, PANEL_KEY, QTY, SERIES, STATE


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sum_by_key(df: DataFrame, keys: list[str] = PANEL_KEY) -> DataFrame:
    """One row per key; partial sums are taken before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(QTY).alias(QTY))


def merge_sum(master: DataFrame, new: DataFrame) -> DataFrame:
    """Add new rows to the panel; a key in both inputs gets the sum."""
    columns = PANEL_KEY + [QTY]
    return sum_by_key(master.select(columns).unionByName(new.select(columns)))


def keep_last(df: DataFrame, order: list[Column], keys: list[str] = PANEL_KEY,
              value: str = QTY) -> DataFrame:
    """The value of the row that sorts last in each key.

    An aggregate rather than a window: a key with very many copies shrinks to
    one row in each task before the shuffle.
    """
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def upsert_keep_last(master: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``master``, which has one row per key.

    Only the pushed rows are aggregated, their last row wins; the master is neither
    sorted nor summed, it loses the keys of the push.
    """
    columns = PANEL_KEY + [QTY]
    fresh = keep_last(new, [*[F.col(c) for c in order], F.col(QTY)])
    return master.select(columns).join(fresh, PANEL_KEY, "left_anti").unionByName(fresh.select(columns))


def distinct_series(df: DataFrame, series: list[str] = SERIES) -> DataFrame:
    return df.select(*series).distinct()


def last_n_per_series(df: DataFrame, n: int, series: list[str] = SERIES) -> DataFrame:
    """Newest n rows of each series; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*series).orderBy(F.col(DATE).desc())
    return (df.withColumn("_rank", F.row_number().over(w))
            .filter(F.col("_rank") <= n).drop("_rank"))


def recent_values(df: DataFrame, n: int = 90, series: list[str] = SERIES) -> DataFrame:
    """One row per series with its last n quantities in date order."""
    pairs = F.collect_list(F.struct(F.col(DATE), F.col(QTY).cast("double").alias("v")))
    return (last_n_per_series(df, n, series).groupBy(*series)
            .agg(F.transform(F.sort_array(pairs), lambda x: x["v"]).alias("history")))


def pad_front(history: Column, n: int, filler: Column) -> Column:
    """Left-pad an array to n values."""
    return F.concat(F.array_repeat(filler, F.greatest(n - F.size(history), F.lit(0))), history)


def by_series_and_date(df: DataFrame) -> DataFrame:
    return df.orderBy(STATE, CATEGORY, DATE)
