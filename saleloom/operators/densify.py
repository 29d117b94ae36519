"""Calendars: the dense panel, forecast spines and holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleloom.functions.rules import STANDARD_CATEGORIES
from saleloom.schema import CATEGORY, DATE, QTY, SERIES, STATE


ROWS_PER_TASK = 10_000  # a task makes the code of all its windows anew, which costs what thousands of rows do


def place_by_series(df: DataFrame, rows: int | None = None, series: list[str] = SERIES) -> DataFrame:
    """Hash placement by series for the windows that follow.

    The number of partitions is named, because adaptive execution would size them
    by bytes and windows cost far more than their bytes. It is that of the session, or
    fewer where ``rows`` tells how many rows there are: a panel is bounded by its series
    and days, however many sales it was summed from.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = min(parts, max(1, -(-rows // ROWS_PER_TASK)))
    return df.repartition(parts, *series)


def dense_calendar(panel: DataFrame, categories: list[str] = STANDARD_CATEGORIES) -> DataFrame:
    """Every day x state x category between the first and last date, absent = 0.

    States come from the panel, categories are the standard ones and days are
    generated, so nothing is cross-joined. Zero rows and sales rows are united and
    summed by key; rows are placed by series first, so the sum and every later
    window over a series share one shuffle. The panel is best stored: its size is
    looked up first.
    """
    size = panel.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(STATE)).alias("states"),
                     (F.datediff(F.max(DATE), F.min(DATE)) + 1).alias("days")).first()
    rows = size["rows"] + size["states"] * len(categories) * (size["days"] or 0)
    span = panel.agg(F.struct(F.min(DATE).alias("a"), F.max(DATE).alias("b")).alias("span"))
    span = span.scalar()
    zeros = (panel.select(STATE).distinct()
             .select(STATE, F.explode(F.array(*[F.lit(c) for c in categories])).alias(CATEGORY))
             .select(STATE, CATEGORY,
                     F.explode(F.sequence(span.getField("a"), span.getField("b"))).alias(DATE),
                     F.lit(0).cast("long").alias(QTY)))
    facts = panel.select(STATE, CATEGORY, DATE, QTY)
    return (place_by_series(zeros.unionByName(facts), rows)
            .groupBy(STATE, CATEGORY, DATE).agg(F.sum(QTY).alias(QTY))
            .select(DATE, STATE, CATEGORY, QTY))


def forecast_spine(series: DataFrame, start: str | Column, days: int) -> DataFrame:
    """Each series x the next ``days`` dates."""
    first = F.lit(start).cast("date") if isinstance(start, str) else start
    return series.withColumn(DATE, F.explode(F.sequence(first, F.date_add(first, days - 1))))


def month_spine(series: DataFrame, start: str, months: int) -> DataFrame:
    """Each series x the first day of the next ``months`` months."""
    first = F.lit(start).cast("date")
    return series.withColumn(
        DATE, F.explode(F.sequence(first, F.add_months(first, months - 1),
                                   F.expr("interval 1 month"))))


def holiday_table(spark, first_year: int, last_year: int, month_days: list[tuple[int, int]]) -> DataFrame:
    """Fixed-date holidays of a span of years (at most 366 rows a year)."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    days = F.array(*[F.make_date(F.col("y"), F.lit(m), F.lit(d)) for m, d in month_days])
    return years.select(F.explode(days).alias(DATE))


def mark_holidays(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """0/1 flag; the holiday table holds one row per date, so it is broadcast."""
    dates = holidays.select(DATE).distinct().withColumn("is_holiday", F.lit(1))
    return (df.join(F.broadcast(dates), DATE, "left").fillna({"is_holiday": 0}))
