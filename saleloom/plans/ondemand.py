"""Forecast of asked series for a horizon, by the strategy that fits the category."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleloom.functions import calendar
from saleloom.operators import allocate, encode, merge, summary, windows
from saleloom.plans import baselines
from saleloom.plans.recursive import (
    Get,
    back,
    calendar_values,
    days_after,
    fold_forward,
    push_value,
    series_state,
    tail_figures,
)
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, SERIES, STATE
from saleloom.session import cut_lineage

HISTORY = 90
WIDTHS, LAGS = windows.DAILY_WINDOWS, windows.DAILY_LAGS
FIGURES = {"mean": WIDTHS, "std": [7, 30], "min": [7], "max": [7], "median": [7]}
# fixed values: categories without a day loop
RUN_RATE_CATEGORIES = ["3-Wheelers", "Bus"]


def model_columns() -> list[str]:
    return (list(calendar_values(date(2000, 1, 1))) + [f"lag_{k}" for k in LAGS]
            + [f"rolling_{s}_{n}" for s, ns in FIGURES.items() for n in ns]
            + list(_from_history(F.col("history"))) + [f"ema_{n}" for n in WIDTHS]
            + ["State_code", "state_overall_mean", "category_overall_mean"])


def _from_history(h: Column) -> dict[str, Column]:
    """Trend, spread, selling days and ratios that follow from the last values and the group means."""
    out: dict[str, Column] = {}
    before = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    for k in windows.SEASONAL_WINDOWS:
        out[f"seasonal_{k}"], out[f"volatility_{k}"] = tail_figures(h, {"mean": [k], "std": [k]})
        out[f"trend_{k}"] = out[f"seasonal_{k}"] - tail_figures(before, {"mean": [k]})[0]
    out["sales_frequency_30d"] = F.size(F.filter(windows.tail(h, 30), lambda x: x > 0))
    state, category = F.col("state_overall_mean"), F.col("category_overall_mean")
    out["state_category_interaction"] = state * category
    out["sales_ratio_to_state_mean"] = back(h, 1) / (state + 1)
    out["sales_ratio_to_category_mean"] = back(h, 1) / (category + 1)
    return {name: c.alias(name) for name, c in out.items()}


def _with_groups(df: DataFrame, panel: DataFrame, codes: DataFrame | None) -> DataFrame:
    """State code and the frozen means of state and category, from the whole panel."""
    sums = windows.series_sums(panel)
    df = df.join(windows.mean_of_sums(sums, [STATE], "state_overall_mean"), STATE, "left")
    df = df.join(windows.mean_of_sums(sums, [CATEGORY], "category_overall_mean"), CATEGORY, "left")
    return encode.apply_codes(df, encode.code_table(panel, STATE) if codes is None else codes, STATE)


def training_rows(panel: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """The same inputs for past days: figures of the 90 rows before each day."""
    w = windows.series_window()
    recent = F.collect_list(F.col(QTY).cast("double")).over(windows.frame(w, HISTORY, "shifted"))
    rows = windows.shifted_ewma(panel.select(*PANEL_KEY, QTY), WIDTHS, name="ema_{n}")
    rows = rows.withColumn("history", recent).filter(F.size("history") == HISTORY)
    rows = _with_groups(rows, panel, codes)
    d, h = F.col(DATE), F.col("history")
    return rows.select(
        DATE, *SERIES, QTY, *calendar.parts(d), *calendar.flags(d), *calendar.cyclical(d),
        *[back(h, k).alias(f"lag_{k}") for k in LAGS], *tail_figures(h, FIGURES, "rolling_"),
        *_from_history(h).values(), *[f"ema_{n}" for n in WIDTHS],
        "State_code", "state_overall_mean", "category_overall_mean")


def start_history(panel: DataFrame) -> DataFrame:
    """90 values per series: the last selling days when there are 90 of them, else the
    last days, else the days there are behind their positive mean, or behind the level of
    a known series that never sold (5)."""
    sold = panel.filter(F.col(QTY) > 0)
    selling = merge.recent_values(sold, HISTORY).withColumnRenamed("history", "_sold")
    means = sold.groupBy(*SERIES).agg(F.avg(QTY).alias("_mean"))
    rows = (merge.recent_values(panel, HISTORY).join(selling, SERIES, "left")
            .join(means, SERIES, "left"))
    padded = merge.pad_front(F.col("history"), HISTORY, F.coalesce(F.col("_mean"), F.lit(summary.LOWEST_LEVEL)))
    return rows.select(*SERIES, F.when(F.size("_sold") == HISTORY, F.col("_sold"))
                       .otherwise(padded).alias("history"))


def weekday_factors(panel: DataFrame) -> DataFrame:
    """One map per series: weekday mean over the mean of the weekday means."""
    profile = summary.weekday_profile(panel)
    entries = F.collect_list(F.struct("day_of_week", "mean_quantity"))
    overall = F.avg("mean_quantity")
    by_series = profile.groupBy(*SERIES).agg(entries.alias("e"), overall.alias("m"))
    return by_series.select(*SERIES, F.transform_values(
        F.map_from_entries("e"),
        lambda _, v: F.when(F.col("m") > 0, v / F.nullif(F.col("m"), F.lit(0.0))).otherwise(1.0))
        .alias("factors"))


def ml_forecast(panel: DataFrame, asked: DataFrame, models: dict[str, PipelineModel],
                start: str, days: int, codes: DataFrame | None = None) -> DataFrame:
    """Day loop on the last 90 values, scaled by the weekday factor.

    ``codes`` are the state codes of the training, by default those of the panel.

    A series whose forecast does not vary is left out.
    """
    history = panel.join(asked.select(*SERIES).distinct(), SERIES, "left_semi")
    sums = series_state(history, HISTORY, WIDTHS).drop("history")
    state = start_history(history).join(sums, SERIES).join(weekday_factors(history), SERIES, "left")
    state = _with_groups(state, panel, codes)

    names = [f"rolling_{s}_{n}" for s, ns in FIGURES.items() for n in ns]

    def features(get: Get) -> dict[str, Column]:
        h = get("history")
        known = {f"lag_{k}": back(h, k) for k in LAGS} | dict(zip(names, tail_figures(h, FIGURES))) | _from_history(h)
        return known | {f"ema_{n}": get(f"sum_{n}") / get(f"weight_{n}") for n in WIDTHS}

    def adjust(p: Column, get: Get) -> Column:
        # rounded before the cut so that 3.9999999999 counts as 4
        whole = F.round(F.greatest(p, F.lit(0.0)), 9).cast("long")
        factor = F.coalesce(F.try_element_at("factors", get("day_of_week")), F.lit(1.0))
        return F.round(whole * factor, 9).cast("long").cast("double")

    path = fold_forward(cut_lineage(state), models, days_after(start, days), calendar_values, features,
                        lambda v, get: push_value(v, HISTORY, WIDTHS, get), adjust)
    path = cut_lineage(path)
    varying = (path.groupBy(*SERIES).agg(F.stddev_pop(PRED).alias("_s")).filter(F.col("_s") > 0)
               .select(*SERIES))
    return path.join(varying, SERIES, "left_semi").select(
        DATE, *SERIES, F.col(PRED).cast("long").alias("Forecasted_Sales"))


def on_demand(panel: DataFrame, asked: DataFrame, models: dict[str, PipelineModel], start: str,
              days: int, pattern_year: int) -> DataFrame:
    """Run rate for the monthly categories, day loop where a model exists, else the
    projection; ``source`` names the strategy of each row."""
    rates = summary.level_or_default(asked, summary.run_rate(panel))
    rates = cut_lineage(rates)
    pattern = allocate.series_pattern(panel, pattern_year)
    monthly = rates.filter(F.col(CATEGORY).isin(RUN_RATE_CATEGORIES))
    a = baselines.run_rate_forecast(monthly, pattern, start, days).withColumnRenamed("Forecasted_Sales", "a")
    others = asked.filter(~F.col(CATEGORY).isin(RUN_RATE_CATEGORIES))
    b = ml_forecast(panel, others, models, start, days).withColumnRenamed("Forecasted_Sales", "b")
    c = baselines.projection(rates, start, days).withColumnRenamed("Forecasted_Sales", "c")
    keys = [DATE, *SERIES]
    joined = c.join(a, keys, "full").join(b, keys, "full")
    source = F.when(F.col("a").isNotNull(), "run rate").when(F.col("b").isNotNull(), "model")
    return joined.select(*keys, F.coalesce("a", "b", "c").alias("Forecasted_Sales"),
                         source.otherwise("projection").alias("source"))

