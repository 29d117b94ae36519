"""Forecast-error expressions, all of them plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; null below two rows; constant actuals score 1 when hit, else 0."""
    total = F.var_pop(y) * F.count(y)
    error = F.sum((y - p) * (y - p))
    return (F.when(F.count(y) < 2, F.lit(None).cast("double"))
            .when(total > 0, 1 - error / F.nullif(total, F.lit(0.0)))
            .otherwise((error == 0).cast("double")))


def mape(y: Column, p: Column) -> Column:
    """In percent, over rows with a non-zero actual; 0 when there is none."""
    ratio = F.abs((y - p) / F.nullif(y, F.lit(0).cast("double")))
    return F.coalesce(F.avg(ratio) * 100, F.lit(0.0))


def mape_all_rows(y: Column, p: Column) -> Column:
    """MAPE without a mask: null (undefined) as soon as one actual is zero."""
    masked = mape(y, p)
    return F.when(F.count_if(y == 0) == 0, masked)


def score_columns(y: Column, p: Column) -> list[Column]:
    """count, MAE, MSE, RMSE, R2 and MAPE in one aggregate."""
    y, p = y.cast("double"), p.cast("double")
    return [F.count(F.lit(1)).alias("records"), mae(y, p).alias("mae"),
            mse(y, p).alias("mse"), rmse(y, p).alias("rmse"), r2(y, p).alias("r2"),
            mape(y, p).alias("mape")]


def quality_grade(r2_value: Column, good_from: float = 0.6,
                  acceptable_from: float | None = 0.3) -> Column:
    """poor below 0, then below expectations, acceptable, good.

    ``acceptable_from=None`` leaves the acceptable band out: everything under
    ``good_from`` is below expectations.
    """
    out = F.when(r2_value.isNull(), "unknown").when(r2_value < 0, "poor")
    if acceptable_from is None:
        return out.when(r2_value < good_from, "below expectations").otherwise("good")
    return (out.when(r2_value < acceptable_from, "below expectations")
            .when(r2_value < good_from, "acceptable").otherwise("good"))
