"""Step-by-step forecasts over all series at once.

The state of a series is one row: its recent values as an array, plus running sums
where a feature reaches further back. ``fold_forward`` takes all steps of a series in
one expression: a step builds features from the state, lets the model, which is an
expression too, score them, and moves the state. A category is one stage, whatever the
number of steps, and nothing is shuffled or stored between them. ``roll_forward`` does
the same for models that only Spark can apply, a plan step for each date.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleloom.operators import encode, merge, windows
from saleloom.operators.group_stats import attach
from saleloom.operators.windows import middle, tail
from saleloom.plans.scorers import Scorer, compiled, let
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, SERIES, STATE
from saleloom.session import cut_lineage, stored


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column, sample: bool = False) -> Column:
    """Deviation of an array; the sample form is null below two values."""
    squares = let(array_mean(a), lambda mean: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)))
    n = F.size(a) - (1 if sample else 0)
    return F.sqrt(squares / F.nullif(n, F.lit(0)))


_FIGURES = {"mean": array_mean, "std": array_std, "min": F.array_min, "max": F.array_max,
            "median": lambda a: middle(F.sort_array(a))}


def tail_figures(history: Column, wanted: dict[str, list[int]], prefix: str = "") -> list[Column]:
    """Figures over the last n values of an array; the deviation is the population one."""
    return [_FIGURES[stat](tail(history, n)).alias(f"{prefix}{stat}_{n}")
            for stat, widths in wanted.items() for n in widths]


# ---- the loop -----------------------------------------------------------------------

ALL = None  # key of a model that serves every category


def roll_forward(state: DataFrame, models: dict[str | None, PipelineModel], dates: list[date],
                 features: Callable[[date], dict[str, Column]],
                 advance: Callable[[Column], dict[str, Column]],
                 adjust: Callable[[Column, date], Column] | None = None,
                 cut_every: int = 10) -> DataFrame:
    """(series, Date, Predicted_Sales) for every date, each prediction feeding the next.

    ``features`` gives the model inputs of a date from the state columns, ``advance``
    the state after a value, ``adjust`` turns the raw prediction into that value (at
    least 0 by default). The loop only builds plans; all series of a category move
    together. Lineage is cut every ``cut_every`` steps and after the last one: a filter
    above the chain would be pushed down through all steps and copy their expressions.
    """
    adjust = adjust or (lambda p, _: F.greatest(p, F.lit(0.0)))
    fixed = state.columns
    inputs = {day: features(day) for day in dates}
    values = {day: adjust(F.col("prediction"), day).alias("_value") for day in dates}
    moved = advance(F.col("_value"))
    next_state = [moved.get(c, F.col(c)).alias(c) for c in fixed]
    longer_path = F.array_append("path", F.col("_value")).alias("path")

    def chain(item: tuple[str | None, PipelineModel]) -> DataFrame:
        category, model = item
        rows = state if category is ALL else state.filter(F.col(CATEGORY) == category)
        rows = rows.withColumn("path", F.array().cast("array<double>"))
        for i, day in enumerate(dates, 1):
            scored = model.transform(rows.withColumns(inputs[day]))
            rows = scored.select(*fixed, "path", values[day]).select(*next_state, longer_path)
            if i % cut_every == 0 or i == len(dates):
                rows = cut_lineage(rows)
        return rows

    with ThreadPoolExecutor(len(models)) as pool:
        path = reduce(DataFrame.unionByName, pool.map(chain, models.items()))
    calendar_array = F.array(*[F.lit(d) for d in dates])
    return (path.select(*SERIES, F.posexplode("path").alias("_i", PRED))
            .select(F.get(calendar_array, F.col("_i")).alias(DATE), *SERIES, PRED))


Get = Callable[[str], Column]  # the present value of a state column


def fold_forward(state: DataFrame, models: dict[str | None, PipelineModel | Scorer], dates: list[date],
                 calendar_of: Callable[[date], dict[str, Column]], features: Callable[[Get], dict[str, Column]],
                 advance: Callable[[Column, Get], dict[str, Column]],
                 adjust: Callable[[Column, Get], Column] | None = None,
                 hot: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """What ``roll_forward`` gives, all steps of a series in one expression.

    ``calendar_of`` gives a date's inputs as literals, ``features`` those that follow from the state,
    ``advance`` the moved state columns after a value. All read the state, and ``adjust`` and ``features``
    the date's literals too, through the getter they are given. See ``compiled`` for ``hot``.
    """
    adjust = adjust or (lambda p, _: F.greatest(p, F.lit(0.0)))
    literals = [calendar_of(day) for day in dates]
    known_days = F.array(*[F.struct(*[c.alias(n) for n, c in of.items()]) for of in literals])
    calendar_names = set(literals[0]) if literals else set()
    moving = list(advance(F.lit(0.0), F.col))

    def chain(category: str | None, model: PipelineModel | Scorer) -> DataFrame:
        scorer = compiled(model, hot)
        rows = state if category is ALL else state.filter(F.col(CATEGORY) == category)

        def step(now: Column, day: Column) -> Column:
            def get(name: str) -> Column:
                return now[name] if name in moving else day[name] if name in calendar_names else F.col(name)

            inputs = {n: get(n) for n in [*state.columns, *calendar_names]} | features(get)

            def after(value: Column) -> Column:
                moved = advance(value, get)
                return F.struct(*[moved[n].alias(n) for n in moving], F.array_append(now["path"], value).alias("path"))

            return let(adjust(scorer.column(inputs), get), after)

        start = F.struct(*[F.col(n) for n in moving], F.array().cast("array<double>").alias("path"))
        path = F.aggregate(known_days, start, step)["path"]
        return scorer.attach(rows).select(*SERIES, path.alias("path"))

    path = reduce(DataFrame.unionByName, [chain(c, m) for c, m in models.items()])
    calendar_array = F.array(*[F.lit(d) for d in dates])
    return (path.select(*SERIES, F.posexplode("path").alias("_i", PRED))
            .select(F.get(calendar_array, F.col("_i")).alias(DATE), *SERIES, PRED))


def days_after(first: str, n: int) -> list[date]:
    start = date.fromisoformat(first)
    return [start + timedelta(days=k) for k in range(n)]


def months_after(first: str, n: int) -> list[date]:
    start = date.fromisoformat(first)
    months = [start.year * 12 + start.month - 1 + k for k in range(n)]
    return [date(m // 12, m % 12 + 1, 1) for m in months]


def back(history: Column, k: int) -> Column:
    """The value k steps ago, 0 where the history is shorter."""
    return F.coalesce(F.try_element_at(history, F.lit(-k)), F.lit(0.0))


# ---- state of a series ---------------------------------------------------------------


def series_state(df: DataFrame, length: int, spans: list[int]) -> DataFrame:
    """Last ``length`` values and, per span, the EWMA sums of the whole series."""
    with_means = windows.ewma(df.select(*PANEL_KEY, QTY), spans, name="e{n}")
    ends = with_means.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max_by(f"e{n}", DATE).alias(f"e{n}") for n in spans])
    sums = []
    for n in spans:
        weight = (1 - F.pow(F.lit(1 - 2 / (n + 1)), F.col("_n"))) * F.lit((n + 1) / 2)
        sums += [(F.col(f"e{n}") * weight).alias(f"sum_{n}"), weight.alias(f"weight_{n}")]
    return merge.recent_values(df, length).join(ends.select(*SERIES, *sums), SERIES)


def push_value(value: Column, length: int, spans: list[int], get: Get = F.col) -> dict[str, Column]:
    """State columns after one more value."""
    longer = F.array_append(get("history"), value)
    moved = {"history": windows.tail(longer, length)}
    for n in spans:
        d = F.lit(1 - 2 / (n + 1))
        moved[f"sum_{n}"] = value + d * get(f"sum_{n}")
        moved[f"weight_{n}"] = 1 + d * get(f"weight_{n}")
    return moved


def calendar_values(day: date) -> dict[str, Column]:
    """The calendar columns of one known date, as literals."""
    after = day + timedelta(days=1)
    year_day = day.timetuple().tm_yday
    numbers = {
        "year": day.year, "month": day.month, "day": day.day, "quarter": (day.month + 2) // 3,
        "day_of_week": day.weekday(), "week_of_year": day.isocalendar()[1],
        "day_of_year": year_day, "is_weekend": int(day.weekday() >= 5),
        "is_month_start": int(day.day == 1), "is_month_end": int(after.day == 1),
        "is_quarter_start": int(day.day == 1 and day.month % 3 == 1),
        "is_quarter_end": int(after.day == 1 and after.month % 3 == 1)}
    for name, value, period in (("month", day.month, 12), ("day_of_week", day.weekday(), 7),
                                ("day_of_year", year_day, 365)):
        numbers[f"{name}_sin"] = math.sin(2 * math.pi * value / period)
        numbers[f"{name}_cos"] = math.cos(2 * math.pi * value / period)
    return {name: F.lit(value) for name, value in numbers.items()}


# ---- monthly ---------------------------------------------------------------------------


def hybrid_calendar(day: date) -> dict[str, Column]:
    angle = 2 * math.pi * day.month / 12
    return {"Month": F.lit(day.month), "Quarter": F.lit((day.month + 2) // 3),
            "Month_Sin": F.lit(math.sin(angle)), "Month_Cos": F.lit(math.cos(angle))}


def hybrid_history(get: Get = F.col) -> dict[str, Column]:
    """The hybrid monthly features that follow from the state of the series."""
    h = get("history")
    out = {f"Lag_{k}": back(h, k) for k in windows.MONTHLY_LAGS}
    for n in windows.MONTHLY_WINDOWS:
        out[f"Roll_Mean_{n}"] = array_mean(windows.tail(h, n))
        out[f"Roll_Std_{n}"] = F.coalesce(array_std(windows.tail(h, n), sample=True), F.lit(0.0))
    out |= {f"EWMA_{n}": get(f"sum_{n}") / get(f"weight_{n}") for n in windows.MONTHLY_SPANS}
    return out


def forecast_months(monthly: DataFrame, codes: DataFrame, models: dict[str, PipelineModel],
                    first: str, months: int = 12) -> DataFrame:
    """Recursive monthly forecast of all series with the hybrid models."""
    spans, length = windows.MONTHLY_SPANS, max(windows.MONTHLY_LAGS)
    state = encode.apply_codes(series_state(monthly, length, spans), codes, STATE)
    return fold_forward(cut_lineage(state), models, months_after(first, months), hybrid_calendar, hybrid_history,
                        lambda v, get: push_value(v, length, spans, get))


# ---- daily -----------------------------------------------------------------------------


def daily_columns(spec: windows.DailySpec) -> list[str]:
    """Inputs of a daily recursive model under a feature spec."""
    stats = ["mean", "std", "min", "max"] + (["median"] if spec.medians else [])
    names = list(calendar_values(date(2000, 1, 1))) + ["sales_frequency_30d"]
    names += [f"lag_{k}" for k in spec.lag_steps]
    names += [f"rolling_{s}_{n}" for n in spec.windows for s in stats]
    names += [f"ema_{n}" for n in spec.windows]
    names += [f"{s}_{k}" for k in windows.SEASONAL_WINDOWS if k in spec.windows for s in ("seasonal", "trend", "volatility")]
    if spec.group_means:
        names += ["state_overall_mean", "category_overall_mean", "state_category_interaction", "sales_ratio_to_category_mean"]
    return names


def daily_history(spec: windows.DailySpec, get: Get = F.col) -> dict[str, Column]:
    """The daily features that follow from the state of the series."""
    h = get("history")
    out = {f"lag_{k}": back(h, k) for k in spec.lag_steps}
    for n in spec.windows:
        last = windows.tail(h, n)
        out |= {f"rolling_mean_{n}": array_mean(last),
                f"rolling_std_{n}": F.coalesce(array_std(last, sample=True), F.lit(0.0)),
                f"rolling_min_{n}": F.array_min(last), f"rolling_max_{n}": F.array_max(last)}
        if spec.medians:
            out[f"rolling_median_{n}"] = middle(F.sort_array(last))
        out[f"ema_{n}"] = get(f"sum_{n}") / get(f"weight_{n}")
    for k in (k for k in windows.SEASONAL_WINDOWS if k in spec.windows):
        out[f"seasonal_{k}"], out[f"volatility_{k}"] = out[f"rolling_mean_{k}"], out[f"rolling_std_{k}"]
        before = windows.tail(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), k)
        out[f"trend_{k}"] = F.when(F.size(before) > 0, out[f"rolling_mean_{k}"] - array_mean(before)).otherwise(0.0)
    if spec.group_means:
        out["sales_ratio_to_category_mean"] = back(h, 1) / (F.col("category_overall_mean") + 1)
    out["sales_frequency_30d"] = F.size(F.filter(windows.tail(h, 30), lambda x: x > 0))
    return out


def daily_state(panel: DataFrame, spec: windows.DailySpec, length: int = 90) -> DataFrame:
    """State of every series with its group means frozen at their history values."""
    state = series_state(panel, length, list(spec.windows))
    if not spec.group_means:
        return state
    by_state = panel.groupBy(STATE).agg(F.avg(QTY).alias("state_overall_mean"))
    by_category = panel.groupBy(CATEGORY).agg(F.avg(QTY).alias("category_overall_mean"))
    state = attach(attach(state, by_state, [STATE]), by_category, [CATEGORY])
    return state.withColumn("state_category_interaction",
                            F.col("state_overall_mean") * F.col("category_overall_mean"))


def forecast_days(panel: DataFrame, models: dict[str | None, PipelineModel], spec: windows.DailySpec,
                  first: str, days: int, whole: bool = False, length: int = 90) -> DataFrame:
    """Recursive daily forecast of all series; ``whole`` cuts each value to an integer."""
    state = cut_lineage(daily_state(panel, spec, length))

    def adjust(p: Column, _: Get) -> Column:
        value = F.greatest(p, F.lit(0.0))
        return value.cast("long").cast("double") if whole else value

    return fold_forward(state, models, days_after(first, days), calendar_values, lambda get: daily_history(spec, get),
                        lambda v, get: push_value(v, length, list(spec.windows), get), adjust)


# ---- all series under one model --------------------------------------------------------


# fixed values: numbers of the one model for all series
NET_NUMBERS = ["month", "year", "quarter", "day_of_week", "lag_1", "lag_3", "lag_7"]


def forecast_all_series(panel: DataFrame, fit: Callable[[DataFrame, list[str], dict[str, DataFrame]], PipelineModel | Scorer],
                        first: str, days: int, kept: int = 60) -> DataFrame:
    """Day by day for all series with one linear model on scaled numbers and one-hot names.

    ``fit`` gets the scaled training rows, the names of the inputs and the stored codes of states and
    categories. Names are sparse vectors made from the codes, however many states there are. Scaling
    parameters are stored figures, so the driver holds one row per number and the model; a series keeps
    its last ``kept`` rows. Predictions go back to units and are cut to whole quantities.
    """
    d = F.col(DATE)
    rows = panel.select(*PANEL_KEY, QTY, F.month(d).alias("month"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
                        F.weekday(d).alias("day_of_week"), *windows.lags([1, 3, 7])).dropna()
    codes = {c: stored(encode.code_table(panel, c), "codes") for c in (CATEGORY, STATE)}
    sizes = {c: codes[c].count() for c in codes}
    params = {r["feature"]: (r["mean"], r["std"]) for r in encode.zscore_parameters(rows, [*NET_NUMBERS, QTY]).collect()}

    def scaled(name: str, value: Column) -> Column:
        mean, std = params[name]
        return (value - F.lit(mean)) / F.lit(std)

    train = rows.select(CATEGORY, STATE, *[scaled(c, F.col(c)).alias(c) for c in [*NET_NUMBERS, QTY]])
    for column, table in codes.items():
        train = encode.one_hot_vector(train, table, column, f"hot_{column}", sizes[column])
    hot = {f"hot_{c}": (f"{c}_code", sizes[c]) for c in codes}
    model = fit(train, [*NET_NUMBERS, *hot], codes)
    state = merge.recent_values(panel, kept)
    for column, table in codes.items():
        state = encode.apply_codes(state, table, column)

    def calendar_of(day: date) -> dict[str, Column]:
        numbers = {"month": day.month, "year": day.year, "quarter": (day.month + 2) // 3, "day_of_week": day.weekday()}
        return {c: scaled(c, F.lit(v)) for c, v in numbers.items()}

    mean, std = params[QTY]
    return fold_forward(
        cut_lineage(state), {ALL: model}, days_after(first, days), calendar_of,
        lambda get: {f"lag_{k}": scaled(f"lag_{k}", back(get("history"), k)) for k in (1, 3, 7)},
        lambda v, get: {"history": windows.tail(F.array_append(get("history"), v), kept)},
        lambda p, _: F.greatest(p * F.lit(std) + F.lit(mean), F.lit(0.0)).cast("long").cast("double"), hot)
