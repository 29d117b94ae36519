"""Projection, filtering and repair of panel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.operators.group_stats import attach
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, QTY, SERIES, STATE

# ---- fixed values: other names of the panel columns in source files ----------
ALIASES = {
    DATE: ["Registration Date", "Month, Year"],
    CATEGORY: ["Vehicle Category", "Vehicle_Class"],
    QTY: ["Registrations", "Number of EVs Registered"],
}


def use_standard_names(df: DataFrame) -> DataFrame:
    """Rename known aliases; a column already under its standard name wins."""
    names = {}
    for standard, others in ALIASES.items():
        if standard not in df.columns:
            names.update({o: standard for o in others if o in df.columns})
    return df.withColumnsRenamed(names)


def require_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fail on a missing column before any job starts."""
    missing = [c for c in (columns or PANEL_KEY + [QTY]) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; found: {df.columns}")
    return df


def coerce_types(df: DataFrame) -> DataFrame:
    """Unreadable dates drop the row, unreadable quantities become 0."""
    return (df.withColumn(DATE, F.try_to_timestamp(F.col(DATE).cast("string")).cast("date"))
            .withColumn(QTY, F.coalesce(F.col(QTY).try_cast("double"), F.lit(0.0))
                        .cast("long"))
            .dropna(subset=[DATE]))


def _known(category: str) -> Column:
    return (F.coalesce(F.col(STATE), F.lit("")) != "Unknown") & (
        F.coalesce(F.col(category), F.lit("Unknown")) != "Unknown")


def drop_unknown(df: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Keep rows whose state is not Unknown and whose category is given."""
    return df.filter(_known(category))


def removal_report(df: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Rows before and after ``drop_unknown`` and the reasons, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col(STATE) == "Unknown").alias("unknown_state"),
        F.count_if(F.coalesce(F.col(category), F.lit("Unknown")) == "Unknown")
        .alias("unknown_category"),
        F.count_if(_known(category)).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def fill_unknown(df: DataFrame, category: str = CATEGORY) -> DataFrame:
    return df.fillna({category: "Unknown"})


def next_year_template(df: DataFrame, year: int, last_rows: int = 1000) -> DataFrame:
    """Rows of a year moved one year ahead with the target set to 0.

    Without rows in that year the newest ``last_rows`` rows serve instead.
    """
    chosen = df.filter(F.year(DATE) == year)
    if chosen.isEmpty():
        chosen = last_rows_of(df, last_rows)
    return (chosen.withColumn(DATE, F.add_months(DATE, 12))
            .withColumn(QTY, F.lit(0).cast("long")))


def last_rows_of(df: DataFrame, n: int) -> DataFrame:
    """Newest n rows of the table (a top-n, not a full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in PANEL_KEY]).limit(n)


def between_dates(df: DataFrame, start: str | None = None, before: str | None = None) -> DataFrame:
    """Half-open date range; literals reach the parquet scan."""
    if start is not None:
        df = df.filter(F.col(DATE) >= F.lit(start).cast("date"))
    if before is not None:
        df = df.filter(F.col(DATE) < F.lit(before).cast("date"))
    return df


def one_series(df: DataFrame, state: str, category: str) -> DataFrame:
    return df.filter((F.col(STATE) == state) & (F.col(CATEGORY) == category))


def whole_not_negative(value: Column) -> Column:
    """Clip at 0 and cut the fraction."""
    return F.greatest(value, F.lit(0.0)).cast("long")


def zero_for_null_numbers(df: DataFrame) -> DataFrame:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric)


def with_missing_days(df: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """One row per day between the first and last day of each series.

    Days that were absent carry a null quantity. The gap after a row is filled
    from that row itself, so no calendar join is needed. A series has one row
    per day at most, which bounds the window.
    """
    w = Window.partitionBy(*series).orderBy(DATE)
    until = F.coalesce(F.date_sub(F.lead(DATE).over(w), 1), F.col(DATE))
    days = df.select(*series, QTY, F.col(DATE).alias("_from"), until.alias("_until"))
    return (days.withColumn(DATE, F.explode(F.sequence("_from", "_until")))
            .withColumn(QTY, F.when(F.col(DATE) == F.col("_from"), F.col(QTY)))
            .drop("_from", "_until"))


def impute_linear(df: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Fill missing days on the line between the neighbours of the gap."""
    w = Window.partitionBy(*series).orderBy(DATE)
    ahead = F.lead(QTY).over(w)
    until = F.coalesce(F.lead(DATE).over(w), F.date_add(DATE, 1))
    gaps = df.select(*series, QTY, ahead.alias("_next"), F.col(DATE).alias("_from"),
                     until.alias("_to"))
    gaps = gaps.withColumn(
        DATE, F.explode(F.sequence("_from", F.date_sub("_to", 1))))
    share = F.datediff(DATE, "_from") / F.datediff("_to", "_from")
    value = F.col(QTY) + F.coalesce(F.col("_next") - F.col(QTY), F.lit(0)) * share
    return gaps.select(DATE, *series, value.alias("imputed"))


def impute_median(df: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Fill missing days with the median of the series' own days."""
    medians = df.groupBy(*series).agg(F.median(QTY).alias("_median"))
    filled = attach(with_missing_days(df, series), medians, series)
    return filled.select(DATE, *series,
                         F.coalesce(F.col(QTY).cast("double"), F.col("_median")).alias("imputed"))
