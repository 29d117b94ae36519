"""Totals, profiles, metric tables and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleloom.functions import scores
from saleloom.operators.group_stats import attach
from saleloom.operators.position import group_quantiles
from saleloom.operators.windows import mean_of_sums, series_sums
from saleloom.schema import CATEGORY, DATE, PRED, QTY, SERIES, STATE


# ---- totals and profiles ---------------------------------------------------------


def national_by_date(df: DataFrame) -> DataFrame:
    return df.groupBy(DATE).agg(F.sum(QTY).alias("actual"), F.sum(PRED).alias("predicted"))


def totals_by(df: DataFrame, keys: list[str], value: str = PRED, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def top_totals(df: DataFrame, key: str, n: int, value: str = PRED) -> DataFrame:
    """The n largest totals; equal totals are taken in key order."""
    return totals_by(df, [key], value).orderBy(F.col("total").desc(), key).limit(n)


def totals_with_subtotals(df: DataFrame, value: str = PRED) -> DataFrame:
    """Grand total, totals by state and totals by category from one aggregate."""
    return (df.groupingSets([[STATE], [CATEGORY], []], STATE, CATEGORY)
            .agg(F.grouping_id().alias("level"), F.sum(value).alias("total"))
            .select(F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "state")
                    .otherwise("category").alias("scope"),
                    F.coalesce(F.col(STATE), F.col(CATEGORY), F.lit("all")).alias("name"), "total"))


def weekday_profile(df: DataFrame, keys: list[str] = SERIES, positive_only: bool = True) -> DataFrame:
    """Mean quantity by weekday (Monday 0)."""
    rows = df.filter(F.col(QTY) > 0) if positive_only else df
    return (rows.groupBy(*keys, F.weekday(DATE).alias("day_of_week"))
            .agg(F.avg(QTY).alias("mean_quantity")))


LOWEST_LEVEL = 5.0  # fixed value: daily level of a known series that hardly sells


def run_rate(panel: DataFrame, n: int = 30) -> DataFrame:
    """Daily level per series: mean of the last n selling days, else of the last n
    days; below 1 counts as 5."""
    newest = F.col(DATE).desc()
    w = Window.partitionBy(*SERIES)
    sold = F.col(QTY) > 0
    ranked = panel.select(
        *SERIES, QTY, sold.alias("_sold"),
        F.row_number().over(w.orderBy(newest)).alias("_any"),
        F.row_number().over(w.orderBy(sold.desc(), newest)).alias("_rank"))
    level = F.coalesce(F.avg(F.when(F.col("_sold") & (F.col("_rank") <= n), F.col(QTY))),
                       F.avg(F.when(F.col("_any") <= n, F.col(QTY))))
    return (ranked.groupBy(*SERIES).agg(level.alias("_level"))
            .select(*SERIES, F.when(F.col("_level") < 1, LOWEST_LEVEL).otherwise(F.col("_level"))
                    .alias("daily_level")))


def level_or_default(series: DataFrame, rates: DataFrame, default: float = 10.0) -> DataFrame:
    """Levels for the asked series; one without history gets the default."""
    return (series.join(rates, SERIES, "left")
            .withColumn("daily_level", F.coalesce(F.col("daily_level"), F.lit(default))))


def spread_by_category(df: DataFrame) -> DataFrame:
    """Mean, deviation and count of actual and predicted values."""
    return df.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(QTY).alias("actual_mean"), F.stddev_samp(QTY).alias("actual_std"),
        F.avg(PRED).alias("predicted_mean"), F.stddev_samp(PRED).alias("predicted_std"))


def range_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy(CATEGORY).agg((F.max(QTY) - F.min(QTY)).alias("actual_range"),
                                    (F.max(PRED) - F.min(PRED)).alias("predicted_range"))


def constant_prediction_check(df: DataFrame) -> DataFrame:
    """A category is constant when its smallest and largest prediction agree."""
    return df.groupBy(CATEGORY).agg(
        F.count_distinct(PRED).alias("distinct_values"),
        (F.min(PRED) == F.max(PRED)).cast("int").alias("is_constant"))


def prediction_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min(PRED).alias("lowest"), F.max(PRED).alias("highest"),
                  F.avg(PRED).alias("mean"), F.stddev_samp(PRED).alias("std"))


def mean_predictor(df: DataFrame, history: DataFrame) -> DataFrame:
    """Mean of the series in ``history``, else of the category."""
    sums = series_sums(history)
    by_series = mean_of_sums(sums, SERIES, "_series")
    by_category = mean_of_sums(sums, [CATEGORY], "_category")
    out = attach(attach(df, by_series, SERIES), by_category, [CATEGORY])
    return out.withColumn(PRED, F.coalesce("_series", "_category")).drop("_series", "_category")


def status(df: DataFrame) -> DataFrame:
    """Row count, date range and number of states, categories and series."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(DATE).alias("first_date"),
                  F.max(DATE).alias("last_date"), F.count_distinct(STATE).alias("states"),
                  F.count_distinct(CATEGORY).alias("categories"),
                  F.sum(QTY).alias("total_quantity"))


# ---- growth and regions ------------------------------------------------------------


def monthly_growth(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Growth against last month and last year, acceleration and turning points.

    ``monthly`` has one row per key and month.
    """
    w = Window.partitionBy(*keys).orderBy(DATE)
    step = F.col(QTY) - F.lag(QTY).over(w)
    df = monthly.select(*keys, DATE, QTY, step.alias("change"),
                        (step * 100.0 / F.nullif(F.lag(QTY).over(w), F.lit(0).cast("long")))
                        .alias("month_growth"),
                        ((F.col(QTY) - F.lag(QTY, 12).over(w)) * 100.0
                         / F.nullif(F.lag(QTY, 12).over(w), F.lit(0).cast("long")))
                        .alias("year_growth"))
    df = df.withColumn("acceleration", F.col("change") - F.lag("change").over(w))
    turn = F.signum("acceleration") * F.signum(F.lag("acceleration").over(w)) < 0
    return df.withColumn("inflection", F.coalesce(turn, F.lit(False)).cast("int"))


def region_strength(df: DataFrame) -> DataFrame:
    """Total per state with ranks from both ends, and deviation over mean by day."""
    days = df.groupBy(STATE, DATE).agg(F.sum(QTY).alias("day_total"))
    states = days.groupBy(STATE).agg(
        F.sum("day_total").alias("total"),
        (F.stddev_samp("day_total") / F.nullif(F.avg("day_total"), F.lit(0.0))).alias("volatility"))
    # one row per state
    return states.select(
        STATE, "total", "volatility",
        F.rank().over(Window.orderBy(F.col("total").desc())).alias("strongest"),
        F.rank().over(Window.orderBy("total")).alias("weakest"))


# ---- metrics ----------------------------------------------------------------------


def metrics(df: DataFrame, keys: list[str] | None = None, actual: str = QTY,
            predicted: str = PRED) -> DataFrame:
    columns = scores.score_columns(F.col(actual), F.col(predicted))
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def national_metrics(df: DataFrame) -> DataFrame:
    return metrics(national_by_date(df), actual="actual", predicted="predicted")


def mean_of_category_metrics(df: DataFrame) -> DataFrame:
    """Plain mean of the category metrics over categories with two dates or more."""
    by_date = df.groupBy(CATEGORY, DATE).agg(F.sum(QTY).alias(QTY), F.sum(PRED).alias(PRED))
    each = metrics(by_date, [CATEGORY]).filter(F.col("records") >= 2)
    return each.agg(F.count(F.lit(1)).alias("categories"),
                    *[F.avg(c).alias(c) for c in ("mae", "rmse", "mape", "r2")])


def rank_categories(df: DataFrame) -> DataFrame:
    """Categories ranked by MAE (small first) and R2 (large first)."""
    table = metrics(df, [CATEGORY])  # one row per category
    return table.select(
        CATEGORY, "records", "mae", "r2",
        F.rank().over(Window.orderBy("mae")).alias("mae_rank"),
        F.rank().over(Window.orderBy(F.col("r2").desc())).alias("r2_rank"))


def after_last(df: DataFrame, months: int | None = None, days: int | None = None) -> DataFrame:
    """Rows of the last k months or days of the table, the usual test set."""
    newest = df.agg(F.max(DATE)).scalar()
    start = F.add_months(newest, -months) if months is not None else F.date_sub(newest, days)
    return df.filter(F.col(DATE) > start)


def hashed_split(df: DataFrame, keys: list[str], train_percent: int = 80) -> DataFrame:
    """Repeatable random split by a hash of the key."""
    bucket = F.pmod(F.xxhash64(F.lit(42), *keys), F.lit(100))
    return df.withColumn("part", F.when(bucket < train_percent, "train").otherwise("test"))


def rolling_origin(df: DataFrame, train_days: int = 180, test_days: int = 30,
                   step_days: int = 30) -> DataFrame:
    """Assign rows to the test window of each fold.

    Fold k trains on ``train_days`` days from first + k * step and tests on the
    ``test_days`` after them. A row may fall in several folds when windows overlap;
    the folds of a row follow from its date, so no fold table is joined.
    """
    span = df.agg(F.struct(F.min(DATE).alias("a"), F.max(DATE).alias("b")).alias("s")).scalar()
    at = F.datediff(DATE, span.getField("a")) - train_days
    last = F.floor((F.datediff(span.getField("b"), span.getField("a"))
                    - train_days - test_days + 1) / step_days)
    newest = F.least(F.floor(at / step_days), last)
    oldest = F.greatest(F.ceil((at - test_days + 1) / step_days), F.lit(0))
    folds = F.when((at >= 0) & (oldest <= newest), F.sequence(oldest, newest))
    return df.withColumn("fold", F.explode(folds))


def interval_coverage(df: DataFrame, history: DataFrame, low: float = 0.05,
                      high: float = 0.95) -> DataFrame:
    """Share of actuals inside prediction + residual quantiles of ``history``."""
    residual = F.col(QTY) - F.col(PRED)
    bounds = group_quantiles(history.select(CATEGORY, residual.alias("_res")), [CATEGORY],
                             "_res", [low, high])
    inside = residual.between(F.col("q0"), F.col("q1"))
    return (attach(df, bounds, [CATEGORY]).groupBy(CATEGORY)
            .agg(F.count(F.lit(1)).alias("records"), F.avg(inside.cast("int")).alias("coverage")))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str] = [CATEGORY]) -> DataFrame:
    """Metrics of two runs side by side; a key may be in one of them only."""
    left = metrics(a, keys).select(*keys, F.col("mae").alias("mae_a"), F.col("r2").alias("r2_a"))
    right = metrics(b, keys).select(*keys, F.col("mae").alias("mae_b"), F.col("r2").alias("r2_b"))

    def better(x: Column, y: Column) -> Column:
        return (F.when(x.isNull() & y.isNull(), "none").when(y.isNull() | (x < y), "a")
                .when(x.isNull() | (y < x), "b").otherwise("tie"))

    return (left.join(right, keys, "full")
            .withColumn("mae_winner", better(F.col("mae_a"), F.col("mae_b")))
            .withColumn("r2_winner", better(-F.col("r2_a"), -F.col("r2_b"))))


def claimed_against_measured(measured: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    return (measured.join(claimed, key, "left")
            .withColumn("difference", F.col("claimed_r2") - F.col("r2")))


def report_table(df: DataFrame) -> DataFrame:
    """Long table: one row per scope and metric, overall and by category."""
    names = ["mae", "mse", "rmse", "r2", "mape"]
    overall = metrics(df).select(F.lit("overall").alias("scope"), "records", *names)
    each = metrics(df, [CATEGORY]).select(F.col(CATEGORY).alias("scope"), "records", *names)
    return overall.unionByName(each).unpivot(["scope", "records"], names, "metric", "value")


# ---- live figures -------------------------------------------------------------------


def newest(feed: DataFrame, n: int, order: list[str]) -> DataFrame:
    return feed.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def live_cards(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count(F.lit(1)).alias("events"), F.avg("error").alias("mean_error"),
                    F.sum("actual").alias("actual_total"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest value, empty bins left out."""
    span = df.agg(F.struct(F.min(value).alias("a"), F.max(value).alias("b")).alias("s")).scalar()
    low, high = span.getField("a"), span.getField("b")
    # width_bucket puts the largest value in bin bins + 1
    bucket = F.least(F.width_bucket(F.col(value), low, high, F.lit(bins)), F.lit(bins).cast("long"))
    return df.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def residuals(df: DataFrame) -> DataFrame:
    """Actual, predicted, residual, absolute and percent error per row."""
    gap = F.col(QTY) - F.col(PRED)
    return df.select(DATE, STATE, CATEGORY, F.col(QTY).alias("actual"), F.col(PRED).alias("predicted"),
                     gap.alias("residual"), F.abs(gap).alias("error"),
                     (F.abs(gap) * 100.0 / F.nullif(F.col(QTY).cast("double"), F.lit(0.0)))
                     .alias("percent_error"))
