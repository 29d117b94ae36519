"""Forecasts without trained trees: naive, autoregressive, run rate, projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleloom.operators import allocate, densify, windows
from saleloom.schema import CATEGORY, DATE, QTY, SERIES, STATE


def naive(df: DataFrame, season: int, series: list[str] = SERIES) -> DataFrame:
    """Mean so far, last value and value one season ago, all known before the row."""
    w = windows.series_window(series)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", F.avg(QTY).over(before).alias("series_mean"),
                     F.lag(QTY, 1).over(w).alias("last_value"),
                     F.lag(QTY, season).over(w).alias("last_season"))


def differences(df: DataFrame, order: int, series: list[str] = SERIES) -> DataFrame:
    """First difference ``d`` and its lags ``d1`` .. ``d<order>``."""
    w = windows.series_window(series)
    step = df.withColumn("d", (F.col(QTY) - F.lag(QTY).over(w)).cast("double"))
    return step.select("*", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, order + 1)])


def ar1_coefficients(df: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Slope and intercept of the difference on the one before."""
    rows = differences(df, 1, series)
    return rows.groupBy(*series).agg(F.regr_slope("d", "d1").alias("slope"),
                                     F.regr_intercept("d", "d1").alias("intercept"))


def ar_coefficients(df: DataFrame, order: int = 5, series: list[str] = SERIES) -> DataFrame:
    """Least-squares autoregression of the differences, no constant.

    One aggregate sums the products; what is left per series is an order x order
    system, solved for a batch of series at a time.
    """
    names = [f"d{k}" for k in range(1, order + 1)]
    rows = differences(df, order, series).dropna(subset=["d", *names])
    left = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    right = [F.sum(F.col(a) * F.col("d")) for a in names]
    sums = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.array(*left).alias("xx"),
                                     F.array(*right).alias("xy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coefficients = []
            for xx, xy in zip(batch["xx"], batch["xy"]):
                matrix = np.array(xx, dtype=float).reshape(order, order)
                coefficients.append(np.linalg.lstsq(matrix, np.array(xy, dtype=float), rcond=None)[0])
            yield batch[[*series, "n"]].assign(coefficients=coefficients)

    schema = ", ".join(f"`{c}` string" for c in series) + ", n long, coefficients array<double>"
    return sums.mapInPandas(solve, schema)


def ar_forecast(df: DataFrame, steps: int, order: int = 5, series: list[str] = SERIES) -> DataFrame:
    """``steps`` months ahead by folding the difference equation over each series.

    A series too short for the order is forecast by its mean.
    """
    w = Window.partitionBy(*series).orderBy(F.col(DATE).desc())
    ranked = df.select(*series, DATE, QTY, F.row_number().over(w).alias("_r"))
    tails = (ranked.filter(F.col("_r") <= order + 1).groupBy(*series)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct(DATE, QTY))),
                              lambda x: x[QTY].cast("double")).alias("h"),
                  F.max(DATE).alias("last")))
    means = df.groupBy(*series).agg(F.avg(QTY).alias("_mean"))
    rows = (tails.join(means, series).join(ar_coefficients(df, order, series), series, "left"))

    def step(history: Column, _: Column) -> Column:
        change = F.lit(0.0)
        for k in range(1, order + 1):
            gap = F.element_at(history, -k) - F.element_at(history, -k - 1)
            change = change + F.element_at(F.col("coefficients"), k) * gap
        return F.concat(history, F.array(F.element_at(history, -1) + change))

    usable = F.col("coefficients").isNotNull() & (F.size("h") == order + 1)
    path = F.when(usable, F.slice(
        F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("h"), step), order + 2, steps)
    ).otherwise(F.array_repeat(F.col("_mean"), steps))
    return (rows.select(*series, "last", F.posexplode(path).alias("i", "forecast"))
            .select(*series, F.add_months("last", F.col("i") + 1).alias(DATE), "forecast"))


def run_rate_forecast(rates: DataFrame, pattern: DataFrame, start: str, days: int,
                      noise: bool = True) -> DataFrame:
    """Level x 30 x 1.05 per month, spread over its days, cut to the horizon."""
    first = F.lit(start).cast("date")
    last = F.date_add(first, days - 1)
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    monthly = rates.select(*SERIES, F.explode(months).alias(DATE),
                           (F.col("daily_level") * 30 * 1.05).cast("long").alias(QTY))
    daily = allocate.allocate_exact(monthly, pattern, out="Forecasted_Sales", noise=noise)
    return daily.filter(F.col(DATE).between(first, last)).select(DATE, *SERIES, "Forecasted_Sales")


def projection(rates: DataFrame, start: str, days: int, noise: bool = False) -> DataFrame:
    """Level growing 2 % in 30 days, times 1.1 on weekends and 0.95 else, cut to whole.

    ``noise`` multiplies by a hashed factor in [0.9, 1.1).
    """
    spine = densify.forecast_spine(rates.select(*SERIES, "daily_level"), start, days)
    i = F.datediff(DATE, F.lit(start).cast("date")) + 1
    value = F.col("daily_level") * F.pow(F.lit(1 + 0.02 / 30), i)
    value = value * F.when(F.weekday(DATE) >= 5, 1.1).otherwise(0.95)
    if noise:
        value = value * (F.lit(0.9) + F.lit(0.2) * F.pmod(F.xxhash64(*SERIES, DATE), F.lit(1_000_000)) / 1e6)
    return spine.select(DATE, STATE, CATEGORY,
                        F.greatest(value.cast("long"), F.lit(0).cast("long")).alias("Forecasted_Sales"))
