"""Lag, rolling and exponentially weighted features of one series.

All windows are partitioned by series. A panel has one row per series and day
(``sum_by_key`` or ``dense_calendar`` sees to that), so the calendar bounds every
partition. ``inclusive`` frames end at the current row; ``shifted`` frames end one
row earlier and are the only ones the models may use.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from saleloom.functions import calendar
from saleloom.operators import group_stats
from saleloom.operators.densify import mark_holidays, place_by_series
from saleloom.schema import CATEGORY, DATE, QTY, SERIES, STATE

CHUNK = 256  # rows per EWMA block: 0.5 ** -256 is still far from overflow
FADED = 1e-20  # a weight that no double in the same sum can feel
MOST_BLOCKS = 1 << 20  # a window of so many blocks reaches over any series of days


def series_window(series: list[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(DATE)


def frame(w: WindowSpec, n: int, mode: str) -> WindowSpec:
    """The last n rows: up to this one (inclusive) or up to the previous (shifted)."""
    if mode not in ("inclusive", "shifted"):
        raise ValueError(f"unknown mode {mode!r}")
    return w.rowsBetween(-(n - 1), 0) if mode == "inclusive" else w.rowsBetween(-n, -1)


def lags(steps: list[int], prefix: str = "lag_", series: list[str] = SERIES,
         suffix: str = "") -> list[Column]:
    w = series_window(series)
    return [F.lag(QTY, k).over(w).alias(f"{prefix}{k}{suffix}") for k in steps]


def before(w: WindowSpec, mode: str, n: int = 0) -> WindowSpec:
    """All rows of the series up to the frame of n rows, that frame left out; with 0 up to the frame's last row."""
    return w.rowsBetween(Window.unboundedPreceding, -n if mode == "inclusive" else -n - 1)


def rolling(windows: list[int], stats: list[str], mode: str, series: list[str] = SERIES,
            name: str = "rolling_{stat}_{n}") -> list[Column]:
    """Rolling figures of whole quantities, from the rows that exist (null where there are none).

    Means and deviations are differences of running totals: count, sum and sum of squares up to the frame's
    end less those before its start, each kept up row by row, so a frame of 90 rows costs what one of 7
    costs. The totals are whole numbers and lose nothing; a series whose squares add up to more than a long is
    refused by Spark's overflow check (10 million a day for a century are not). ``min`` and ``max`` walk
    their frames here; ``rolling_extremes`` does not.
    """
    w = series_window(series)
    x = F.col(QTY)
    frame(w, 1, mode)  # refuses an unknown mode

    def within(total: Callable[[WindowSpec], Column], n: int) -> Column:
        none = F.lit(0).cast("long")
        return F.coalesce(total(before(w, mode)), none) - F.coalesce(total(before(w, mode, n)), none)

    def figure(stat: str, n: int) -> Column:
        if stat in ("min", "max"):
            return getattr(F, stat)(x).over(frame(w, n, mode))
        rows = within(lambda over: F.count(x).over(over), n)
        total = within(lambda over: F.sum(x).over(over), n)
        if stat == "mean":
            return F.when(rows > 0, total / rows)
        if stat != "std":
            raise ValueError(f"unknown figure {stat!r}")
        squares = within(lambda over: F.sum(x * x).over(over), n)
        return F.when(rows > 1, F.sqrt((rows * squares - total * total) / (rows * (rows - 1))))

    return [figure(s, n).alias(name.format(stat=s, n=n)) for n in windows for s in stats]


def rolling_extremes(df: DataFrame, windows: list[int], mode: str, stats: tuple[str, ...] = ("min", "max"),
                     series: list[str] = SERIES, name: str = "rolling_{stat}_{n}") -> DataFrame:
    """Rolling minima and maxima by doubling: the figure of 2 k rows is that of k rows and of the k rows before.

    Two overlapping stretches of a power of two make up any frame, so the widest one takes a step for each
    power below it, all in the order the rows already have, instead of a walk over its rows.
    """
    w = series_window(series)
    pick = {"min": F.least, "max": F.greatest}
    start = F.col(QTY) if mode == "inclusive" else F.lag(QTY).over(w)
    frame(w, 1, mode)
    out = df.withColumns({f"_{s}_1": start for s in stats})
    powers = [1]
    while 2 * powers[-1] <= max(windows):
        k = powers[-1]
        out = out.withColumns({f"_{s}_{2 * k}": pick[s](f"_{s}_{k}", F.lag(f"_{s}_{k}", k).over(w)) for s in stats})
        powers.append(2 * k)
    half = {n: max(k for k in powers if k <= n) for n in windows}
    figures = [(F.col(f"_{s}_{k}") if n == k else pick[s](f"_{s}_{k}", F.lag(f"_{s}_{k}", n - k).over(w))).alias(name.format(stat=s, n=n))
               for n, k in half.items() for s in stats]
    return out.select(*df.columns, *figures)


def middle(sorted_array: Column) -> Column:
    """Median of a sorted array, null when it is empty.

    ``get`` answers null outside the array; a ``when`` around it would keep Spark
    from sharing the sort between both halves.
    """
    n = F.size(sorted_array)
    low = F.get(sorted_array, F.floor((n - 1) / 2).cast("int"))
    high = F.get(sorted_array, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def tail(array: Column, n: int) -> Column:
    """Last n elements, or all of a shorter array."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def rolling_medians(df: DataFrame, windows: list[int], series: list[str] = SERIES,
                    name: str = "rolling_median_{n}", mode: str = "inclusive") -> DataFrame:
    """Rolling medians; one array of the widest window serves all widths."""
    recent = F.collect_list(QTY).over(frame(series_window(series), max(windows), mode))
    medians = [middle(F.sort_array(tail(F.col("_recent"), n))).alias(name.format(n=n))
               for n in windows]
    return df.withColumn("_recent", recent).select("*", *medians).drop("_recent")


def ewma(df: DataFrame, spans: list[int], series: list[str] = SERIES,
         name: str = "ema_{n}") -> DataFrame:
    """Bias-adjusted exponential mean, a = 2 / (span + 1), by a scan of two levels.

    A series is cut into blocks of ``CHUNK`` rows. Inside a block the weighted sum
    is one running sum of x * d^-r, scaled by d^r (d = 1 - a, r = row in block). Each
    block's first row takes the end values of the blocks before it, fades and adds
    them, as far back as their weight is not below ``FADED``, and hands the result on
    to the block's other rows: so a row costs the same for a span of 7 and of 2000,
    and the second level sees one value in ``CHUNK``. The weights need no sum: they
    are (1 - d^rows) / a. Every row counts, so a null quantity is filled before (it
    would weigh in as 0). With span 1 the mean is the value itself.
    """
    decay = {n: 1 - 2 / (n + 1) for n in spans if n > 1}
    row = F.row_number().over(series_window(series)) - 1
    base = df.withColumn("_row", row).select(
        "*", F.floor(F.col("_row") / CHUNK).alias("_block"),
        F.pmod(F.col("_row"), F.lit(CHUNK)).alias("_r"))
    # both levels read the rows in one order, that of blocks and days
    inside = (Window.partitionBy(*series, "_block").orderBy(DATE)
              .rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.partitionBy(*series).orderBy("_block", DATE).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select("*", *[
        (F.sum(F.col(QTY) * F.pow(F.lit(d), -F.col("_r"))).over(inside)
         * F.pow(F.lit(d), F.col("_r"))).alias(f"_local_{n}") for n, d in decay.items()])
    # nulls are skipped by collect_list, so an array holds one entry per full block
    full = F.when(F.col("_r") == CHUNK - 1, F.struct(F.lit(0).alias("_"), *[f"_local_{n}" for n in decay]))
    ends = local.withColumn("_ends", F.collect_list(full).over(earlier))

    def start(n: int) -> Column:
        d = decay[n]
        reach = min(math.ceil(math.log(FADED) / (CHUNK * math.log(d))), MOST_BLOCKS)
        faded = F.aggregate(tail(F.col("_ends"), reach), F.lit(0.0),
                            lambda acc, end: acc * F.lit(d ** CHUNK) + end[f"_local_{n}"])
        return F.when(F.col("_r") == 0, faded).alias(f"_start_{n}")

    started = ends.select(*[c for c in ends.columns if c != "_ends"], *[start(n) for n in decay])
    carried = started.withColumns({f"_start_{n}": F.first(f"_start_{n}").over(inside) for n in decay})

    def value(n: int) -> Column:
        if n == 1:
            return F.col(QTY).cast("double").alias(name.format(n=n))
        d = decay[n]
        top = F.col(f"_local_{n}") + F.col(f"_start_{n}") * F.pow(F.lit(d), F.col("_r") + 1)
        weights = (1 - F.pow(F.lit(d), F.col("_row") + 1)) / F.lit(1 - d)
        return (top / weights).alias(name.format(n=n))

    return carried.select(*df.columns, *[value(n) for n in spans])


def shifted_ewma(df: DataFrame, spans: list[int], series: list[str] = SERIES,
                 name: str = "EWMA_{n}") -> DataFrame:
    """EWMA over the rows before the current one; null on the first row."""
    w = series_window(series)
    out = ewma(df, spans, series, name)
    return out.select(*df.columns, *[F.lag(name.format(n=n)).over(w).alias(name.format(n=n))
                                     for n in spans])


def first_difference(column: str, name: str, series: list[str] = SERIES) -> Column:
    """Change against the previous row of the same series, 0 on the first."""
    w = series_window(series)
    return F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0.0)).alias(name)


def selling_days(n: int = 30, full: bool = False, series: list[str] = SERIES, mode: str = "inclusive") -> Column:
    """Days with sales in the last n rows, from running totals; ``full`` gives null until n rows exist."""
    w = series_window(series)
    upto, until = before(w, mode), before(w, mode, n)
    known = F.count(QTY).over(upto) - F.count(QTY).over(until)
    sold = (F.col(QTY) > 0).cast("int")
    days = F.sum(sold).over(upto) - F.coalesce(F.sum(sold).over(until), F.lit(0).cast("long"))
    return F.when(known == n, days) if full else F.when(known > 0, days)


def sales_before(series: list[str] = SERIES) -> Column:
    """Selling days before the current row."""
    w = series_window(series).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum((F.col(QTY) > 0).cast("int")).over(w), F.lit(0))


def expanding_mean(series: list[str] = SERIES) -> Column:
    return F.avg(QTY).over(series_window(series).rowsBetween(Window.unboundedPreceding, 0))


def lookback(n: int = 3, series: list[str] = SERIES) -> Column:
    """The n values before the row, oldest first; null until n exist."""
    over = frame(series_window(series), n, "shifted")
    return F.when(F.count(QTY).over(over) == n, F.collect_list(QTY).over(over))


def full_window_mean(n: int = 3, mode: str = "shifted", series: list[str] = SERIES) -> Column:
    over = frame(series_window(series), n, mode)
    return F.when(F.count(QTY).over(over) == n, F.avg(QTY).over(over))


# ---- fixed values: widths of the daily feature set -------------------------------
DAILY_LAGS = [1, 2, 3, 7, 14, 30, 60, 90]
DAILY_WINDOWS = [7, 14, 30, 60, 90]
SEASONAL_WINDOWS = [7, 30, 60]

# ---- fixed values: widths of the monthly feature sets ----------------------------
MONTHLY_LAGS = [1, 2, 3, 6, 12]
MONTHLY_WINDOWS = [3, 6, 12]
MONTHLY_SPANS = [3, 12]


@dataclass(frozen=True)
class DailySpec:
    """Which columns ``daily_features`` adds.

    ``means_until`` limits the overall means to rows before that date, so that a
    model sees only training figures.
    """

    mode: str = "inclusive"
    lag_steps: tuple[int, ...] = tuple(DAILY_LAGS)
    windows: tuple[int, ...] = tuple(DAILY_WINDOWS)
    medians: bool = True
    group_means: bool = True
    means_until: str | None = None


def daily_features(panel: DataFrame, spec: DailySpec = DailySpec(),
                   holidays: DataFrame | None = None) -> DataFrame:
    """The daily feature set: group means, lags, rolling, exponential, calendar.

    Means come first, while rows are narrow: their joins and the state-day window
    need other placements than the series windows, which then share one shuffle.
    In ``shifted`` mode every figure that would contain the row's own quantity is
    computed from earlier rows, and the ratios use the previous day's quantity.
    The panel is best stored: with group means its rows are counted first.
    """
    windows = list(spec.windows)
    df = panel
    if spec.group_means:
        df = place_by_series(add_group_means(df, spec.means_until), panel.count())
    df = mark_holidays(df, holidays) if holidays is not None else df
    emas = ewma if spec.mode == "inclusive" else shifted_ewma
    df = emas(df, windows, name="ema_{n}")
    if spec.medians:
        df = rolling_medians(df, windows, mode=spec.mode)
    df = rolling_extremes(df, windows, spec.mode)
    df = df.select("*", *lags(list(spec.lag_steps)), *rolling(windows, ["mean", "std"], spec.mode),
                   selling_days(30, mode=spec.mode).alias("sales_frequency_30d"))
    seasonal = [k for k in SEASONAL_WINDOWS if k in windows]
    d = F.col(DATE)
    df = df.select(
        "*", *[F.col(f"rolling_mean_{k}").alias(f"seasonal_{k}") for k in seasonal],
        *[first_difference(f"rolling_mean_{k}", f"trend_{k}") for k in seasonal],
        *[F.col(f"rolling_std_{k}").alias(f"volatility_{k}") for k in seasonal],
        *calendar.parts(d), *calendar.flags(d), *calendar.cyclical(d))
    return add_ratios(df, spec.mode) if spec.group_means else df


def add_group_means(df: DataFrame, until: str | None = None) -> DataFrame:
    """Mean of the state on the day, and overall means of state and category.

    The state-day mean groups one row per category. The overall means are
    aggregates joined back, over the rows before ``until`` where it is given.
    """
    known = df if until is None else df.filter(F.col(DATE) < F.lit(until).cast("date"))
    by_state = mean_of_sums(series_sums(known), [STATE], "state_overall_mean")
    by_category = mean_of_sums(series_sums(known), [CATEGORY], "category_overall_mean")
    df = df.withColumn("state_daily_mean", F.avg(QTY).over(Window.partitionBy(STATE, DATE)))
    return group_stats.attach(group_stats.attach(df, by_state, [STATE]), by_category, [CATEGORY])


def series_sums(df: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Sum and count of the known quantities of each series: coarser means need no more."""
    return df.groupBy(*series).agg(F.sum(QTY).alias("_sum"), F.count(QTY).alias("_count"))


def mean_of_sums(sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    return sums.groupBy(*keys).agg((F.sum("_sum") / F.nullif(F.sum("_count"), F.lit(0).cast("long"))).alias(name))


def add_ratios(df: DataFrame, mode: str = "inclusive", offset: float = 1.0) -> DataFrame:
    """Product of the overall means and the ratios of sales to the group means.

    ``shifted`` mode takes the quantity and the state-day mean of the previous row.
    """
    own, state_day = F.col(QTY), F.col("state_daily_mean")
    if mode == "shifted":
        w = series_window()
        own, state_day = F.lag(QTY).over(w), F.lag("state_daily_mean").over(w)
    df = df.withColumns({"_own": own, "_state_day": state_day})
    out = df.select(
        "*", (F.col("state_overall_mean") * F.col("category_overall_mean"))
        .alias("state_category_interaction"),
        (F.col("_own") / (F.col("_state_day") + offset)).alias("sales_ratio_to_state_mean"),
        (F.col("_own") / (F.col("category_overall_mean") + offset))
        .alias("sales_ratio_to_category_mean"))
    if mode == "shifted":
        out = out.withColumn("state_daily_mean", F.col("_state_day"))
    return out.drop("_own", "_state_day")


# ---- monthly --------------------------------------------------------------------


def monthly_totals(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Daily rows to one row per key and month, dated on the first of the month."""
    return (panel.groupBy(*keys, F.trunc(DATE, "MM").alias("_month")).agg(F.sum(QTY).alias(QTY))
            .select(*keys, F.col("_month").alias(DATE), F.year("_month").alias("Year"),
                    F.month("_month").alias("Month"), QTY))


def hybrid_monthly_features(monthly: DataFrame) -> DataFrame:
    """Leak-safe monthly set: lags, shifted rolling mean/std, shifted EWMA; nulls are 0."""
    df = shifted_ewma(monthly, MONTHLY_SPANS)
    d = F.col(DATE)
    df = df.select(
        "*", F.quarter(d).alias("Quarter"),
        *[c.alias(n) for c, n in zip(calendar.cyclical(d)[:2], ["Month_Sin", "Month_Cos"])],
        *lags(MONTHLY_LAGS, "Lag_"),
        *rolling(MONTHLY_WINDOWS, ["mean"], "shifted", name="Roll_Mean_{n}"),
        *rolling(MONTHLY_WINDOWS, ["std"], "shifted", name="Roll_Std_{n}"))
    return df.fillna(0)


def specialised_monthly_features(monthly: DataFrame, mode: str = "inclusive",
                                 series: list[str] = SERIES) -> DataFrame:
    """Monthly set of the one-category models; ``shifted`` keeps the target out."""
    d = F.col(DATE)
    w = series_window(series)
    seen = w.rowsBetween(Window.unboundedPreceding, 0 if mode == "inclusive" else -1)
    df = rolling_extremes(monthly.drop("Year", "Month"), MONTHLY_WINDOWS, mode, ("max",), series, "roll_{stat}_{n}m").select(
        "*", F.month(d).alias("month"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        *lags(MONTHLY_LAGS, "lag_month_", series),
        *rolling(MONTHLY_WINDOWS, ["mean", "std"], mode, series, "roll_{stat}_{n}m"),
        F.avg(QTY).over(seen).alias("state_avg"))
    df = df.withColumn("momentum", F.col("roll_mean_3m") / (F.col("roll_mean_12m") + 1))
    return df.fillna(0)
