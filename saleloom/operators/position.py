"""Row positions in a sorted table, with no single-task sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleloom.operators.group_stats import attach
from saleloom.session import cut_lineage


def with_position(df: DataFrame, order: list[str], name: str = "position",
                  group: list[str] | None = None, size: str | None = None) -> DataFrame:
    """1-based position in sort order, over the table or inside each group.

    ``size`` names a column for the number of rows of the group.

    The sort is range-partitioned, so a group may span many tasks. Each task
    numbers its own rows; only one count per partition is summed up in sequence.
    The sorted rows are checkpointed first: both passes must see one placement.
    """
    group = group or []
    ordered = cut_lineage(df.orderBy(*group, *order))
    marked = ordered.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_mark"))
    # one row per partition: bounded by the number of partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    # the low 33 bits of the mark count rows inside the partition
    local = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    placed = (marked.join(F.broadcast(offsets), "_part")
              .withColumn(name, local + F.col("_offset") + 1)
              .drop("_part", "_mark", "_offset"))
    if not group:
        return placed
    figures = [(F.min(name) - 1).alias("_first")]
    if size:
        figures.append(F.count(F.lit(1)).alias(size))
    return (attach(placed, placed.groupBy(*group).agg(*figures), group)
            .withColumn(name, F.col(name) - F.col("_first")).drop("_first"))


def every_nth(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... of the sorted table."""
    return (with_position(df, order, "_pos")
            .filter(F.pmod(F.col("_pos") - 1, F.lit(n)) == 0).drop("_pos"))


def positional_split(df: DataFrame, group: list[str], order: list[str],
                     train_share: float = 0.85) -> DataFrame:
    """Mark the first share of each sorted group as train, the rest as test."""
    placed = with_position(df, order, "_pos", group, "_n")
    cut = F.floor(F.col("_n") * F.lit(train_share))
    return (placed
            .withColumn("part", F.when(F.col("_pos") <= cut, "train").otherwise("test"))
            .drop("_pos", "_n"))


def group_quantiles(df: DataFrame, group: list[str], value: str,
                    shares: list[float]) -> DataFrame:
    """Exact interpolated quantiles per group as columns ``q0``, ``q1``, ...

    Read off a range-partitioned sort by position, so no task holds a whole group
    or its set of distinct values. Nulls are left out.
    """
    rows = df.select(*group, value).dropna(subset=[value])
    placed = with_position(rows, [value], "_pos", group, "_n")
    at = {i: (F.col("_n") - 1) * F.lit(p) for i, p in enumerate(shares)}
    low = {i: F.floor(x) + 1 for i, x in at.items()}
    pick = {i: F.col("_pos").isin(low[i], F.least(low[i] + 1, F.col("_n"))) for i in at}
    wanted = placed.filter(reduce(lambda a, b: a | b, pick.values()))

    def value_at(i: int):
        below = F.max(F.when(F.col("_pos") == low[i], F.col(value)))
        above = F.max(F.when(F.col("_pos") == F.least(low[i] + 1, F.col("_n")), F.col(value)))
        part = F.max(at[i] - F.floor(at[i]))
        return (below + (above - below) * part).cast("double").alias(f"q{i}")

    return wanted.groupBy(*group).agg(*[value_at(i) for i in at])
