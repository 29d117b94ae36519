"""Monthly totals to daily quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleloom.functions import calendar
from saleloom.schema import CATEGORY, DATE, PRED, QTY, SERIES, STATE


def category_pattern(panel: DataFrame, through_year: int) -> DataFrame:
    """(category, month, day, weight): share of the day in the month, over all
    states and years up to ``through_year``; 1/30 where the month sold nothing."""
    days = (panel.filter(F.year(DATE) <= through_year)
            .groupBy(CATEGORY, F.month(DATE).alias("month"), F.dayofmonth(DATE).alias("day"))
            .agg(F.sum(QTY).alias("sold")))
    total = F.sum("sold").over(Window.partitionBy(CATEGORY, "month"))  # 31 rows at most
    weight = F.coalesce(F.try_divide(F.col("sold").cast("double"), total), F.lit(1 / 30))
    return days.select(CATEGORY, "month", "day", weight.alias("weight"))


def series_pattern(panel: DataFrame, year: int) -> DataFrame:
    """(state, category, month, day, weight, days) from one reference year; months
    that sold nothing have no pattern. ``days`` is the number of pattern days."""
    by_month = Window.partitionBy(*SERIES, "month")  # 31 rows at most
    sold = panel.filter(F.year(DATE) == year).select(
        *SERIES, F.month(DATE).alias("month"), F.dayofmonth(DATE).alias("day"), QTY)
    return (sold.select(*SERIES, "month", "day", F.sum(QTY).over(by_month).alias("_total"),
                        F.count(QTY).over(by_month).cast("int").alias("days"), QTY)
            .filter(F.col("_total") > 0)
            .select(*SERIES, "month", "day", (F.col(QTY) / F.col("_total")).alias("weight"), "days"))


def hashed_weight(*key: str) -> Column:
    """Repeatable noise in [0.8, 1.2) standing in for random fallback weights."""
    return F.lit(0.8) + F.lit(0.4) * F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / F.lit(1e6)


def to_days(monthly: DataFrame) -> DataFrame:
    """One row per day of each month; the month stays in ``_month``."""
    return (monthly.withColumn("_month", F.trunc(DATE, "MM"))
            .withColumn(DATE, F.explode(calendar.days_of_month(F.col("_month"))))
            .withColumns({"month": F.month(DATE), "day": F.dayofmonth(DATE)}))


def allocate_exact(monthly: DataFrame, pattern: DataFrame, total: str = QTY,
                   out: str = QTY, noise: bool = True, keys: list[str] = SERIES) -> DataFrame:
    """Spread whole monthly totals over days so that the days add up exactly.

    Weights come from ``pattern`` where it covers every day of the month, else from
    hashed noise (``noise=False``: even weights). Each day gets the floor of its
    share; what is left goes one by one to the largest fractions, earlier days
    first. ``monthly`` has one row per ``keys`` and month.

    The pattern joins the months before they grow to days, as an array of at most 31
    weights; the windows over the days of a month reuse the placement of that join.
    """
    weights = pattern.groupBy(*SERIES, "month").agg(
        F.map_from_entries(F.collect_list(F.struct("day", "weight"))).alias("_weights"))
    first = monthly.withColumns({"_month": F.trunc(DATE, "MM"), "month": F.month(DATE),
                                 "_total": F.greatest(F.col(total), F.lit(0).cast("long"))})
    joined = first.drop(total, DATE).join(weights, [*SERIES, "month"], "left")
    usable = F.size("_weights") == calendar.days_in_month(F.col("_month"))
    days = joined.withColumns({"_usable": F.coalesce(usable, F.lit(False)),
                               DATE: F.explode(calendar.days_of_month(F.col("_month")))})
    spare = hashed_weight(*keys, DATE) if noise else F.lit(1.0)
    raw = days.withColumn("_w", F.when(
        F.col("_usable"), F.try_element_at("_weights", F.dayofmonth(DATE))).otherwise(spare))
    month = Window.partitionBy(*keys, "month", "_month")
    share = raw.drop("_weights").withColumn("_w", F.col("_w") / F.sum("_w").over(month))
    # rounded before the floor so that 3.9999999999 counts as 4
    split = share.withColumn("_x", F.round(F.col("_total") * F.col("_w"), 9))
    split = split.withColumns({"_floor": F.floor("_x"),
                               "_rest": F.round(F.col("_x") - F.floor("_x"), 9)})
    rank = F.row_number().over(month.orderBy(F.col("_rest").desc(), DATE))
    left = F.col("_total") - F.sum("_floor").over(month)
    return (split.select("*", rank.alias("_rank"), left.alias("_left"))
            .withColumn(out, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long"))
                        .cast("long"))
            .drop("_month", "month", "_usable", "_w", "_x", "_floor", "_rest", "_rank", "_left",
                  "_total"))


def allocate_by_pattern(monthly: DataFrame, pattern: DataFrame, total: str = PRED) -> DataFrame:
    """Total x category weight per day (1/days where unknown), fraction cut, no repair."""
    days = to_days(monthly).join(pattern, [CATEGORY, "month", "day"], "left")
    weight = F.coalesce(F.col("weight"), 1 / calendar.days_in_month(F.col("_month")))
    return days.select(DATE, STATE, CATEGORY, (F.col(total) * weight).cast("long").alias(PRED))


def allocate_evenly(monthly: DataFrame, total: str = PRED) -> DataFrame:
    """Total / days of the month on each day, fraction cut."""
    return to_days(monthly).select(
        DATE, STATE, CATEGORY,
        (F.col(total) / calendar.days_in_month(F.col("_month"))).cast("long").alias(PRED))


def month_onto_days(daily: DataFrame, monthly: DataFrame, value: str,
                    keys: list[str] = SERIES) -> DataFrame:
    """The monthly figure on each existing day, null where the month has none."""
    table = monthly.select(*keys, F.trunc(DATE, "MM").alias("_month"), value)
    return (daily.withColumn("_month", F.trunc(DATE, "MM"))
            .join(table, [*keys, "_month"], "left").drop("_month"))


def thirtieth_onto_days(daily: DataFrame, monthly: DataFrame, value: str = "Monthly_Pred",
                        keys: list[str] = SERIES) -> DataFrame:
    """A thirtieth of the monthly figure on each existing day, fraction cut, absent = 0."""
    return (month_onto_days(daily, monthly, value, keys)
            .withColumn(PRED, F.coalesce((F.col(value) / 30).cast("long"), F.lit(0).cast("long")))
            .drop(value))


def within_horizon(daily: DataFrame, start: str, end: str) -> DataFrame:
    return daily.filter(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
