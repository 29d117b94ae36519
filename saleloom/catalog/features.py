"""Window, calendar, encoding, scaling and allocation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, r6, rounded
from saleloom.functions import calendar
from saleloom.operators import allocate, clean, encode, position, summary, windows
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, SERIES, STATE
from saleloom.session import cut_lineage, new_folder

KEY_SQL = 'CAST("Date" AS VARCHAR) AS "Date", "State", "Vehicle_Category"'
Q = '"EV_Sales_Quantity"'


# decays such as 3/4 give values that lie exactly between two numbers of six digits; shown
# figures are moved off these ties before rounding, here and in the SQL alike
OFF_TIES = 3e-10


def _off_ties(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.lit(OFF_TIES) for c in df.columns if c.lower().startswith(("ema_", "ewma_"))})


def _lag_sql(steps: list[int], prefix: str, suffix: str = "") -> str:
    return ", ".join(f"lag({Q}, {k}) OVER @W AS {prefix}{k}{suffix}" for k in steps)


_SQL_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}


def _roll_sql(widths: list[int], stats: list[str], mode: str, name: str) -> str:
    over = {n: f"@FRAME({n - 1})" if mode == "inclusive" else f"@BEFORE({n})" for n in widths}
    return ", ".join(f"round({_SQL_STATS[s]}({Q}) OVER {over[n]}, 6) AS {name.format(stat=s, n=n)}"
                     for n in widths for s in stats)


def _ewma_sql(source: str, spans: list[int], lag: bool = False, name: str = "ema_{n}",
              middle: int = 1200, digits: int = 6) -> str:
    """Closed form: weights (1-a)^-row around a middle row, so powers stay in range."""
    sums = ", ".join(
        f"sum({Q} * pow({1 - 2 / (n + 1)!r}, {middle} - i)) OVER @W * pow({1 - 2 / (n + 1)!r}, i - {middle})"
        f" / ((1 - pow({1 - 2 / (n + 1)!r}, i + 1)) / {2 / (n + 1)!r}) AS e{n}" for n in spans)
    shown = ", ".join(
        f"round({f'lag(e{n}) OVER @W' if lag else f'e{n}'} + {OFF_TIES}, {digits}) AS {name.format(n=n)}" for n in spans)
    return (f'SELECT {KEY_SQL}, {shown} FROM (SELECT *, {sums} FROM '
            f'(SELECT *, row_number() OVER @W - 1 AS i FROM {source}))')


# ---- windows on days -------------------------------------------------------------


@query("F1", f"SELECT {KEY_SQL}, {_lag_sql(windows.DAILY_LAGS, 'lag_')} FROM panel_dense")
def daily_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.dense(spark, sf_dir).select(*PANEL_KEY, *windows.lags(windows.DAILY_LAGS))


@query("F3", f"SELECT {KEY_SQL}, {_lag_sql([1, 3, 7], 'lag_')} FROM panel")
def short_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the sparse panel: a lag counts rows, not days."""
    return inputs.panel(spark, sf_dir).select(*PANEL_KEY, *windows.lags([1, 3, 7]))


@query("F4,F11,F13", f"""SELECT {KEY_SQL},
{_roll_sql(windows.DAILY_WINDOWS, ['mean', 'std', 'min', 'max'], 'inclusive', 'rolling_{stat}_{n}')},
{_roll_sql([7, 30, 60], ['mean'], 'inclusive', 'seasonal_{n}')},
{_roll_sql([7, 30, 60], ['std'], 'inclusive', 'volatility_{n}')} FROM panel_dense""")
def rolling_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.rolling_extremes(inputs.dense(spark, sf_dir), windows.DAILY_WINDOWS, "inclusive")
    df = df.select("*", *windows.rolling(windows.DAILY_WINDOWS, ["mean", "std"], "inclusive")).drop(QTY)
    return rounded(df.select("*", *[F.col(f"rolling_mean_{k}").alias(f"seasonal_{k}") for k in (7, 30, 60)],
                             *[F.col(f"rolling_std_{k}").alias(f"volatility_{k}") for k in (7, 30, 60)]))


@query("F4", f"""SELECT {KEY_SQL},
{_roll_sql(windows.DAILY_WINDOWS, ['median'], 'inclusive', 'rolling_{stat}_{n}')} FROM panel_dense""")
def rolling_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.rolling_medians(inputs.dense(spark, sf_dir), windows.DAILY_WINDOWS)
    return rounded(df.drop(QTY))


@query("F6", f"""SELECT {KEY_SQL}, coalesce(lag({Q}, 1) OVER @W, 0) AS lag_1_day,
coalesce(lag({Q}, 7) OVER @W, 0) AS lag_7_days,
round(coalesce(avg({Q}) OVER @BEFORE(7), 0), 6) AS rolling_mean_7_days,
round(coalesce(stddev_samp({Q}) OVER @BEFORE(7), 0), 6) AS rolling_std_7_days,
round(coalesce(avg({Q}) OVER @BEFORE(30), 0), 6) AS rolling_mean_30_days FROM panel_dense""")
def rolling_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak-safe daily features of the hurdle model."""
    from saleloom.plans.models import hurdle_features
    df = hurdle_features(inputs.dense(spark, sf_dir))
    return rounded(df.select(*PANEL_KEY, "lag_1_day", "lag_7_days", "rolling_mean_7_days",
                             "rolling_std_7_days", "rolling_mean_30_days"))


@query("F7,F21", f"""SELECT {KEY_SQL}, round(CASE WHEN n = 3 THEN m END, 6) AS rolling_mean_3,
CASE WHEN n = 3 THEN l3 END AS lookback_1, CASE WHEN n = 3 THEN l2 END AS lookback_2,
CASE WHEN n = 3 THEN l1 END AS lookback_3 FROM (SELECT *, count(*) OVER @BEFORE(3) AS n,
avg({Q}) OVER @BEFORE(3) AS m, lag({Q}, 1) OVER @W AS l1, lag({Q}, 2) OVER @W AS l2, lag({Q}, 3) OVER @W AS l3 FROM monthly)""")
def full_window_mean_and_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.monthly(spark, sf_dir).select(
        *PANEL_KEY, windows.full_window_mean(3).alias("rolling_mean_3"), windows.lookback(3).alias("past"))
    return rounded(df.select(*PANEL_KEY, "rolling_mean_3",
                             *[F.col("past")[i].alias(f"lookback_{i + 1}") for i in range(3)]))


@query("F9", _ewma_sql("panel_dense", windows.DAILY_WINDOWS))
def ewma_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_off_ties(windows.ewma(inputs.dense(spark, sf_dir), windows.DAILY_WINDOWS).drop(QTY)))


@query("F12", f"""SELECT {KEY_SQL}, {', '.join(
    f'round(coalesce(m{k} - lag(m{k}) OVER @W, 0), 6) + 0 AS trend_{k}, round(m{k}, 6) AS old_trend_{k}' for k in (7, 30, 60))}
FROM (SELECT *, {', '.join(f'avg({Q}) OVER @FRAME({k - 1}) AS m{k}' for k in (7, 30, 60))} FROM panel_dense)""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the rolling mean; the older form is the rolling mean itself."""
    means = inputs.dense(spark, sf_dir).select(
        *PANEL_KEY, *windows.rolling([7, 30, 60], ["mean"], "inclusive", name="old_trend_{n}"))
    return rounded(means.select("*", *[windows.first_difference(f"old_trend_{k}", f"trend_{k}")
                                       for k in (7, 30, 60)]))


@query("F14,F15", f"""SELECT {KEY_SQL}, CAST(sum(CAST({Q} > 0 AS INTEGER)) OVER @FRAME(29) AS BIGINT) AS sales_frequency_30d,
CASE WHEN count(*) OVER @FRAME(29) = 30 THEN CAST(sum(CAST({Q} > 0 AS INTEGER)) OVER @FRAME(29) AS BIGINT) END AS strict_30d,
CAST(coalesce(sum(CAST({Q} > 0 AS INTEGER)) OVER (PARTITION BY "State", "Vehicle_Category" ORDER BY "Date"
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sold_before FROM panel_dense""")
def selling_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.dense(spark, sf_dir).select(
        *PANEL_KEY, windows.selling_days(30).alias("sales_frequency_30d"),
        windows.selling_days(30, full=True).alias("strict_30d"), windows.sales_before().alias("sold_before"))


@query("F20", f"""SELECT {KEY_SQL}, CASE WHEN rn <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY "Vehicle_Category" ORDER BY "State", "Date") AS rn,
count(*) OVER (PARTITION BY "Vehicle_Category") AS n FROM panel_dense)""")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.dense(spark, sf_dir).select(*PANEL_KEY)
    return position.positional_split(rows, [CATEGORY], [STATE, DATE])


# ---- windows on months ------------------------------------------------------------


@query("F2", f"SELECT {KEY_SQL}, {_lag_sql(windows.MONTHLY_LAGS, 'Lag_')} FROM monthly")
def monthly_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.monthly(spark, sf_dir).select(*PANEL_KEY, *windows.lags(windows.MONTHLY_LAGS, "Lag_"))


@query("F5", f"""SELECT {KEY_SQL},
{_roll_sql(windows.MONTHLY_WINDOWS, ['mean', 'std'], 'shifted', 'Roll_{stat}_{n}')} FROM monthly""")
def rolling_monthly_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inputs.monthly(spark, sf_dir).select(*PANEL_KEY, *windows.rolling(
        windows.MONTHLY_WINDOWS, ["mean", "std"], "shifted", name="Roll_{stat}_{n}")))


@query("F8,F16,F17", f"""SELECT {KEY_SQL},
{_roll_sql(windows.MONTHLY_WINDOWS, ['mean', 'max'], 'inclusive', 'roll_{stat}_{n}m')},
{', '.join(f'round(coalesce(stddev_samp({Q}) OVER @FRAME({n - 1}), 0), 6) AS roll_std_{n}m' for n in windows.MONTHLY_WINDOWS)},
round(avg({Q}) OVER @FRAME(2) / (avg({Q}) OVER @FRAME(11) + 1), 6) AS momentum,
round(avg({Q}) OVER (PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" ROWS UNBOUNDED PRECEDING), 6) AS state_avg
FROM monthly""")
def rolling_monthly_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.specialised_monthly_features(inputs.monthly(spark, sf_dir))
    shown = [f"roll_{s}_{n}m" for n in windows.MONTHLY_WINDOWS for s in ("mean", "std", "max")]
    return rounded(df.select(*PANEL_KEY, *shown, "momentum", "state_avg"))


@query("F10", _ewma_sql("monthly", windows.MONTHLY_SPANS, lag=True, name="EWMA_{n}", middle=40))
def ewma_shifted_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.shifted_ewma(inputs.monthly(spark, sf_dir), windows.MONTHLY_SPANS)
    return rounded(_off_ties(df.select(*PANEL_KEY, "EWMA_3", "EWMA_12")))


@query("F22", f"""WITH a AS (SELECT "Vehicle_Category", "Date", CAST(sum({Q}) AS BIGINT) AS q FROM full_months GROUP BY ALL),
b AS (SELECT *, q - lag(q) OVER w AS change, round((q - lag(q) OVER w) * 100.0 / nullif(lag(q) OVER w, 0), 6) + 0 AS month_growth,
round((q - lag(q, 12) OVER w) * 100.0 / nullif(lag(q, 12) OVER w, 0), 6) + 0 AS year_growth FROM a
WINDOW w AS (PARTITION BY "Vehicle_Category" ORDER BY "Date")),
c AS (SELECT *, change - lag(change) OVER (PARTITION BY "Vehicle_Category" ORDER BY "Date") AS acceleration FROM b)
SELECT CAST("Date" AS VARCHAR) AS "Date", "Vehicle_Category", q AS "EV_Sales_Quantity", change, month_growth, year_growth, acceleration,
CAST(coalesce(sign(acceleration) * sign(lag(acceleration) OVER (PARTITION BY "Vehicle_Category" ORDER BY "Date")) < 0, false) AS INTEGER) AS inflection
FROM c""")
def monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    national = (inputs.full_months(spark, sf_dir).groupBy(CATEGORY, DATE).agg(F.sum(QTY).alias(QTY)))
    return rounded(summary.monthly_growth(national, [CATEGORY]))


@query("F23", f"""SELECT "State", total, round(sd / nullif(av, 0), 6) AS volatility, rank() OVER (ORDER BY total DESC) AS strongest,
rank() OVER (ORDER BY total) AS weakest FROM (SELECT "State", CAST(sum(t) AS BIGINT) AS total, stddev_samp(t) AS sd, avg(t) AS av
FROM (SELECT "State", "Date", sum({Q}) AS t FROM panel_dense GROUP BY 1, 2) GROUP BY 1)""")
def region_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.region_strength(inputs.dense(spark, sf_dir)))


# ---- the whole daily feature frame ---------------------------------------------------


def _whole_frame_sql() -> str:
    """Monthly means of every column of the inclusive daily set."""
    spans = windows.DAILY_WINDOWS
    d = '"Date"'
    first = [f"lag(q, {k}) OVER @W AS lag_{k}" for k in windows.DAILY_LAGS]
    first += [f"{_SQL_STATS[s]}(q) OVER @FRAME({n - 1}) AS rolling_{s}_{n}" for n in spans for s in _SQL_STATS]
    first += [f"sum(q * pow({1 - 2 / (n + 1)!r}, 1200 - i)) OVER @W * pow({1 - 2 / (n + 1)!r}, i - 1200)"
              f" / ((1 - pow({1 - 2 / (n + 1)!r}, i + 1)) / {2 / (n + 1)!r}) AS ema_{n}" for n in spans]
    first += ["sum(CAST(q > 0 AS INTEGER)) OVER @FRAME(29) AS sales_frequency_30d"]
    second = [f"rolling_mean_{k} AS seasonal_{k}, rolling_std_{k} AS volatility_{k}, "
              f"coalesce(rolling_mean_{k} - lag(rolling_mean_{k}) OVER @W, 0) AS trend_{k}" for k in windows.SEASONAL_WINDOWS]
    waves = {"month": (f"month({d})", 12), "day_of_week": (f"(isodow({d}) - 1)", 7), "day_of_year": (f"dayofyear({d})", 365)}
    plain = {"is_holiday": f'CAST({d} IN (SELECT "Date" FROM holidays) AS INTEGER)', "state_daily_mean": "sd", "state_overall_mean": "sm",
             "category_overall_mean": "cm", "state_category_interaction": "sm * cm", "sales_ratio_to_state_mean": "q / (sd + 1)",
             "sales_ratio_to_category_mean": "q / (cm + 1)", "EV_Sales_Quantity": "q", "day": f"day({d})", "quarter": f"quarter({d})",
             "day_of_week": f"isodow({d}) - 1", "week_of_year": f"week({d})", "day_of_year": f"dayofyear({d})",
             "is_weekend": f"CAST(isodow({d}) >= 6 AS INTEGER)", "is_month_start": f"CAST(day({d}) = 1 AS INTEGER)",
             "is_month_end": f"CAST({d} = last_day({d}) AS INTEGER)",
             "is_quarter_start": f"CAST(day({d}) = 1 AND month({d}) IN (1, 4, 7, 10) AS INTEGER)",
             "is_quarter_end": f"CAST({d} = last_day({d}) AND month({d}) IN (3, 6, 9, 12) AS INTEGER)",
             **{f"{n}_{fn}": f"{fn}(2 * pi() * {v} / {p})" for n, (v, p) in waves.items() for fn in ("sin", "cos")}}
    windowed = ([f"lag_{k}" for k in windows.DAILY_LAGS] + [f"rolling_{s}_{n}" for n in spans for s in _SQL_STATS]
                + [f"ema_{n}" for n in spans] + ["sales_frequency_30d"]
                + [f"{x}_{k}" for k in windows.SEASONAL_WINDOWS for x in ("seasonal", "volatility", "trend")])
    shown = {**{c: f"coalesce({c}, 0)" for c in windowed}, **plain}
    means = ", ".join(f'round(avg({x}) + {OFF_TIES}, 4) + 0 AS "{c}"' for c, x in shown.items())
    return f"""SELECT "State", "Vehicle_Category", year({d}) AS year, month({d}) AS month, count(*) AS days, {means}
FROM (SELECT *, {', '.join(second)} FROM (SELECT *, {', '.join(first)} FROM (SELECT *, {Q} AS q, row_number() OVER @W - 1 AS i,
avg({Q}) OVER (PARTITION BY "State", "Date") AS sd, avg({Q}) OVER (PARTITION BY "State") AS sm,
avg({Q}) OVER (PARTITION BY "Vehicle_Category") AS cm FROM panel_dense))) GROUP BY 1, 2, 3, 4"""


@query("F1,F4,F9,F11,F12,F13,F14,F18,C7,G1,G2,G3,G7,G8", _whole_frame_sql())
def daily_feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete inclusive feature set, shown as monthly means of all its columns."""
    df = windows.daily_features(inputs.stored_dense(spark, sf_dir), holidays=inputs.holidays(spark))
    df = clean.zero_for_null_numbers(df)
    keys = [STATE, CATEGORY, "year", "month"]
    figures = [c for c in df.columns if c not in (*keys, DATE)]
    return rounded(df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), *[(F.avg(c) + F.lit(OFF_TIES)).alias(c) for c in figures]), 4)


def _leak_safe_sql() -> str:
    """Every column of the shifted daily set, from windows over the dense panel."""
    spans = windows.DAILY_WINDOWS
    zero = "coalesce({}, 0)"
    base = [f"lag({Q}, {k}) OVER @W AS lag_{k}" for k in windows.DAILY_LAGS]
    base += [f"{_SQL_STATS[s]}({Q}) OVER @BEFORE({n}) AS rolling_{s}_{n}" for n in spans for s in _SQL_STATS]
    base += [f"sum({Q} * pow({1 - 2 / (n + 1)!r}, 1200 - i)) OVER @W * pow({1 - 2 / (n + 1)!r}, i - 1200)"
             f" / ((1 - pow({1 - 2 / (n + 1)!r}, i + 1)) / {2 / (n + 1)!r}) AS e{n}" for n in spans]
    base += [f"sum(CAST({Q} > 0 AS INTEGER)) OVER @BEFORE(30) AS sold",
             f"lag({Q}) OVER @W AS own", "lag(sd) OVER @W AS state_day",
             f"avg(CASE WHEN \"Date\" < DATE '2001-01-01' THEN {Q} END) OVER (PARTITION BY \"State\") AS sm",
             f"avg(CASE WHEN \"Date\" < DATE '2001-01-01' THEN {Q} END) OVER (PARTITION BY \"Vehicle_Category\") AS cm"]
    second = [f"lag(e{n}) OVER @W AS ema_{n}" for n in spans]
    second += [f"rolling_mean_{k} - lag(rolling_mean_{k}) OVER @W AS trend_{k}" for k in (7, 30, 60)]
    out = [f"{zero.format(f'lag_{k}')} AS lag_{k}" for k in windows.DAILY_LAGS]
    out += [f"round({zero.format(f'rolling_{s}_{n}')}, 6) AS rolling_{s}_{n}" for n in spans for s in _SQL_STATS]
    out += [f"round({zero.format(f'ema_{n}')} + {OFF_TIES}, 6) AS ema_{n}" for n in spans]
    out += [f"round({zero.format(f'rolling_mean_{k}')}, 6) AS seasonal_{k}" for k in (7, 30, 60)]
    out += [f"round({zero.format(f'rolling_std_{k}')}, 6) AS volatility_{k}" for k in (7, 30, 60)]
    out += [f"round({zero.format(f'trend_{k}')}, 6) + 0 AS trend_{k}" for k in (7, 30, 60)]
    d = '"Date"'
    waves = {"month": (f"month({d})", 12), "day_of_week": (f"(isodow({d}) - 1)", 7), "day_of_year": (f"dayofyear({d})", 365)}
    out += [f"round({fn}(2 * pi() * {v} / {p}), 6) + 0 AS {n}_{fn}" for n, (v, p) in waves.items() for fn in ("sin", "cos")]
    return f"""SELECT {KEY_SQL}, {Q}, CAST({d} IN (SELECT "Date" FROM holidays) AS INTEGER) AS is_holiday,
coalesce(sold, 0) AS sales_frequency_30d, round(coalesce(state_day, 0), 6) AS state_daily_mean,
round(sm, 6) AS state_overall_mean, round(cm, 6) AS category_overall_mean, round(sm * cm, 6) AS state_category_interaction,
round(own / (state_day + 1), 6) AS sales_ratio_to_state_mean, round(own / (cm + 1), 6) AS sales_ratio_to_category_mean,
year({d}) AS year, month({d}) AS month, day({d}) AS day, quarter({d}) AS quarter, isodow({d}) - 1 AS day_of_week,
week({d}) AS week_of_year, dayofyear({d}) AS day_of_year, CAST(isodow({d}) >= 6 AS INTEGER) AS is_weekend,
CAST(day({d}) = 1 AS INTEGER) AS is_month_start, CAST({d} = last_day({d}) AS INTEGER) AS is_month_end,
CAST(day({d}) = 1 AND month({d}) IN (1, 4, 7, 10) AS INTEGER) AS is_quarter_start,
CAST({d} = last_day({d}) AND month({d}) IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end, {', '.join(out)}
FROM (SELECT *, {', '.join(second)} FROM (SELECT *, {', '.join(base)} FROM (SELECT *, row_number() OVER @W - 1 AS i,
avg({Q}) OVER (PARTITION BY "State", "Date") AS sd FROM panel_dense))) WHERE {d} >= DATE '2001-01-01'"""


@query("F1,F4,F9,F12,F13,F14,F18,G1,G2,G3,G7,G8", _leak_safe_sql())
def daily_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the leak-safe daily set from 2001 on, features looking back freely."""
    spec = windows.DailySpec(mode="shifted", means_until=inputs.TEST_FROM)
    df = windows.daily_features(inputs.stored_dense(spark, sf_dir), spec, inputs.holidays(spark))
    return rounded(_off_ties(clean.zero_for_null_numbers(clean.between_dates(df, start=inputs.TEST_FROM))))


# ---- calendar and scalar functions -----------------------------------------------------


@query("G1,G2,G3,G4,G5,G10", f"""SELECT CAST("Date" AS VARCHAR) AS "Date", year("Date") AS year, month("Date") AS month, day("Date") AS day,
quarter("Date") AS quarter, isodow("Date") - 1 AS day_of_week, week("Date") AS week_of_year, dayofyear("Date") AS day_of_year,
CAST(isodow("Date") >= 6 AS INTEGER) AS is_weekend, CAST(day("Date") = 1 AS INTEGER) AS is_month_start,
CAST("Date" = last_day("Date") AS INTEGER) AS is_month_end,
CAST(day("Date") = 1 AND month("Date") IN (1, 4, 7, 10) AS INTEGER) AS is_quarter_start,
CAST("Date" = last_day("Date") AND month("Date") IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end,
round(sin(2 * pi() * month("Date") / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * month("Date") / 12), 6) + 0 AS month_cos,
round(sin(2 * pi() * (isodow("Date") - 1) / 7), 6) + 0 AS day_of_week_sin, round(cos(2 * pi() * (isodow("Date") - 1) / 7), 6) + 0 AS day_of_week_cos,
round(sin(2 * pi() * dayofyear("Date") / 365), 6) + 0 AS day_of_year_sin, round(cos(2 * pi() * dayofyear("Date") / 365), 6) + 0 AS day_of_year_cos,
"Date" - (SELECT min("Date") FROM panel) AS time_index, "Date" - DATE '1994-01-01' AS days_since_start,
day(last_day("Date")) AS days_in_month FROM (SELECT DISTINCT "Date" FROM panel)""")
def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = cut_lineage(inputs.panel(spark, sf_dir).select(DATE).distinct())
    first = dates.agg(F.min(DATE)).scalar()
    d = F.col(DATE)
    return rounded(dates.select(
        DATE, *calendar.parts(d), *calendar.flags(d), *calendar.cyclical(d),
        F.datediff(d, first).alias("time_index"),
        calendar.days_since(d, "1994-01-01").alias("days_since_start"),
        calendar.days_in_month(d).alias("days_in_month")))


@query("G6", f"""SELECT {KEY_SQL}, round(ln(1 + {Q}), 6) AS log_quantity, {Q} AS restored FROM panel""")
def log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = inputs.panel(spark, sf_dir).select(*PANEL_KEY, F.log1p(QTY).alias("log_quantity"))
    return rounded(logged.withColumn("restored", F.round(F.expm1("log_quantity"), 6).cast("long")))


@query("G9,H1", """SELECT DISTINCT month("Date")::VARCHAR || '_' || "State" AS month_state, (isodow("Date") - 1)::VARCHAR || '_' || "State" AS dow_state,
dense_rank() OVER (ORDER BY month("Date")::VARCHAR || '_' || "State") - 1 AS month_state_code,
dense_rank() OVER (ORDER BY (isodow("Date") - 1)::VARCHAR || '_' || "State") - 1 AS dow_state_code FROM panel""")
def interaction_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.stored_panel(spark, sf_dir)
    pairs = panel.select(
        encode.interaction_key(F.month(DATE), F.col(STATE)).alias("month_state"),
        encode.interaction_key(F.weekday(DATE), F.col(STATE)).alias("dow_state")).distinct()
    for column in ("month_state", "dow_state"):
        pairs = encode.apply_codes(pairs, encode.code_table(pairs, column), column)
    return pairs


# ---- encoding and scaling ----------------------------------------------------------------


@query("H1,H2", """SELECT "State", "Vehicle_Category", count(*) AS n,
coalesce((SELECT count(DISTINCT p2."State") FROM panel p2 WHERE p2."State" < p."State" AND p2."Date" < DATE '2001-01-01' AND p2."State" <> 'NATION_3')
 * CASE WHEN "State" = 'NATION_3' THEN NULL ELSE 1 END, -1) AS "State_code"
FROM panel p WHERE "Date" >= DATE '2001-01-01' GROUP BY ALL""")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes fitted on training rows, stored, loaded and applied; unseen = -1."""
    panel = inputs.stored_panel(spark, sf_dir)
    train = clean.between_dates(panel, before=inputs.TEST_FROM).filter(F.col(STATE) != "NATION_3")
    path = new_folder(spark, "codes")
    encode.code_table(train, STATE).write.parquet(path)
    test = clean.between_dates(panel, start=inputs.TEST_FROM)
    coded = encode.apply_codes(test, spark.read.parquet(path), STATE)
    return coded.groupBy(STATE, CATEGORY, "State_code").agg(F.count(F.lit(1)).alias("n"))


@query("H3", f"""SELECT {KEY_SQL}, {', '.join(
    f'''CAST("Vehicle_Category" = '{c}' AS INTEGER) AS "cat_{c}"''' for c in ('2-Wheelers', '3-Wheelers', '4-Wheelers', 'Bus', 'Others'))},
{', '.join(f'''CAST("State" = 'NATION_{i}' AS INTEGER) AS "state_NATION_{i}"''' for i in range(25))}
FROM panel WHERE "Date" >= DATE '2001-01-01'""")
def one_hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.stored_panel(spark, sf_dir)
    categories, states = encode.known_values(panel, CATEGORY), encode.known_values(panel, STATE)
    return clean.between_dates(panel, start=inputs.TEST_FROM).select(
        *PANEL_KEY, *encode.one_hot(CATEGORY, categories, "cat"), *encode.one_hot(STATE, states, "state"))


@query("H5,H9", f"""SELECT {KEY_SQL}, round((q - m) / s, 6) + 0 AS quantity_scaled, round((mon - mm) / ms, 6) + 0 AS month_scaled,
CAST(q AS DOUBLE) AS restored FROM (SELECT *, {Q} AS q, month("Date") AS mon FROM panel WHERE "Date" >= DATE '2000-06-01'),
(SELECT avg({Q}) AS m, stddev_pop({Q}) + 1e-6 AS s, avg(month("Date")) AS mm, stddev_pop(month("Date")) + 1e-6 AS ms
 FROM panel WHERE "Date" < DATE '2000-06-01')""")
def zscore_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters from training rows, stored as a table, applied and undone."""
    df = inputs.stored_panel(spark, sf_dir).select(
        *PANEL_KEY, F.col(QTY).cast("double").alias("quantity"), F.month(DATE).cast("double").alias("mon"))
    params = cut_lineage(encode.zscore_parameters(
        clean.between_dates(df, before=inputs.TRAIN_BEFORE), ["quantity", "mon"]))
    later = clean.between_dates(df, start=inputs.TRAIN_BEFORE)
    scaled = encode.apply_zscore(later, params, ["quantity", "mon"])
    scaled = scaled.select(*PANEL_KEY, F.col("quantity").alias("quantity_scaled"),
                           F.col("mon").alias("month_scaled"), F.col("quantity").alias("restored"))
    return rounded(encode.undo_zscore(scaled, params, "restored", "quantity"))


@query("H6", f"""SELECT {KEY_SQL}, round((q - med) / iqr, 6) + 0 AS quantity_scaled FROM
(SELECT *, {Q} AS q FROM full_months),
(SELECT median({Q}) AS med, coalesce(nullif(quantile_cont({Q}, 0.75) - quantile_cont({Q}, 0.25), 0), 1) AS iqr
 FROM full_months WHERE "Date" < DATE '2000-06-01')""")
def robust_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut_lineage(inputs.full_months(spark, sf_dir).select(
        *PANEL_KEY, F.col(QTY).cast("double").alias("quantity_scaled")))
    params = encode.robust_parameters(clean.between_dates(df, before=inputs.TRAIN_BEFORE),
                                      ["quantity_scaled"])
    return rounded(encode.apply_robust(df, cut_lineage(params), ["quantity_scaled"]))


@query("H6", f"""SELECT 0 AS pos, 'EV_Sales_Quantity' AS feature, median({Q}) AS center,
coalesce(nullif(quantile_cont({Q}, 0.75) - quantile_cont({Q}, 0.25), 0), 1) AS scale FROM panel""")
def robust_scaling_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refit on all rows after validation, as parameters."""
    return encode.robust_parameters(inputs.panel(spark, sf_dir), [QTY])


@query("H7", f"""SELECT {KEY_SQL}, round((q - lo) / (hi - lo), 6) AS unit, round((q - lo) / (hi - lo) * 2 - 1, 6) + 0 AS plus_minus,
q AS restored FROM (SELECT *, CAST({Q} AS DOUBLE) AS q FROM full_months),
(SELECT CAST(min({Q}) AS DOUBLE) AS lo, CAST(max({Q}) AS DOUBLE) AS hi FROM full_months WHERE "Date" < DATE '2000-06-01')""")
def minmax_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut_lineage(inputs.full_months(spark, sf_dir).select(
        *PANEL_KEY, F.col(QTY).cast("double").alias("unit")))
    params = cut_lineage(encode.minmax_parameters(
        clean.between_dates(df, before=inputs.TRAIN_BEFORE), ["unit"]))
    wide = encode.apply_minmax(df, params, ["unit"]).withColumn("plus_minus", F.col("unit") * 2 - 1)
    back = encode.undo_minmax(wide.select(*PANEL_KEY, F.col("unit").alias("u"), "plus_minus", "unit"),
                              params, ["unit"])
    return rounded(back.select(*PANEL_KEY, F.col("u").alias("unit"), "plus_minus",
                               F.col("unit").alias("restored")))


@query("H8", f"""SELECT {KEY_SQL}, coalesce(CAST(lag({Q}, 7) OVER @W AS DOUBLE), 0) AS lag_7, CAST(0 AS DOUBLE) AS temperature,
coalesce(CAST(lag({Q}, 1) OVER @W AS DOUBLE), 0) AS lag_1 FROM panel_dense""")
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored list rules: lag_3 is dropped, temperature is added as 0."""
    df = inputs.dense(spark, sf_dir).select(*PANEL_KEY, *windows.lags([1, 3, 7]))
    return encode.align_features(df, ["lag_7", "temperature", "lag_1"], PANEL_KEY)


@query("H10", f"""SELECT "State", total, tier, dense_rank() OVER (ORDER BY tier) - 1 AS tier_code FROM (
SELECT "State", total, CASE WHEN total >= 0.9 * mx THEN 0 WHEN total >= 0.8 * mx THEN 1 ELSE 2 END AS tier FROM (
SELECT "State", CAST(sum({Q}) AS BIGINT) AS total, max(sum({Q})) OVER () AS mx FROM panel GROUP BY 1))""")
def state_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = cut_lineage(encode.state_tiers(inputs.stored_panel(spark, sf_dir), [0.9, 0.8]))
    return encode.apply_codes(tiers, encode.code_table(tiers, "tier"), "tier")


# ---- monthly to daily -----------------------------------------------------------------------

WEIGHTS_2000 = f"""SELECT "State", "Vehicle_Category", month("Date") AS m, day("Date") AS d, {Q} AS q,
sum({Q}) OVER (PARTITION BY "State", "Vehicle_Category", month("Date")) AS t,
count(*) OVER (PARTITION BY "State", "Vehicle_Category", month("Date")) AS n FROM panel_dense WHERE year("Date") = 2000"""

DAYS_2001 = f"""SELECT "State", "Vehicle_Category", {Q} AS total, "Date" AS mm, day(last_day("Date")) AS len,
CAST(unnest(generate_series("Date", last_day("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM full_months WHERE "Year" = 2001"""


def _exact_sql(total: str) -> str:
    return f"""SELECT CAST("Date" AS VARCHAR) AS "Date", "State", "Vehicle_Category",
CAST(f + CASE WHEN row_number() OVER (PARTITION BY "State", "Vehicle_Category", mm ORDER BY round(x - f, 9) DESC, "Date")
 <= total - sum(f) OVER (PARTITION BY "State", "Vehicle_Category", mm) THEN 1 ELSE 0 END AS BIGINT) AS "EV_Sales_Quantity"
FROM (SELECT *, floor(x) AS f FROM (SELECT a."State", a."Vehicle_Category", a.mm, a."Date", {total} AS total,
round({total} * CASE WHEN w.t > 0 AND w.n = a.len THEN w.q / w.t ELSE 1.0 / a.len END, 9) AS x
FROM ({DAYS_2001}) a LEFT JOIN ({WEIGHTS_2000}) w ON w."State" = a."State" AND w."Vehicle_Category" = a."Vehicle_Category"
 AND w.m = month(a."Date") AND w.d = day(a."Date")))"""


@query("I1", _exact_sql("a.total"))
def allocate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2001 totals on 2000 weights; February 2000 has 29 weights, so 2001 falls back."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    months = clean.between_dates(windows.monthly_totals(dense), inputs.TEST_FROM,
                                 inputs.LAST_FULL_DAY_BEFORE).select(*PANEL_KEY, QTY)
    pattern = allocate.series_pattern(dense, inputs.PATTERN_YEAR)
    return allocate.allocate_exact(months, pattern, noise=False).select(*PANEL_KEY, QTY)


@query("I1,I5", f"""SELECT "State", "Vehicle_Category", CAST("Date" AS VARCHAR) AS month, {Q} AS month_total,
{Q} AS allocated, 0 AS negative_days, day(last_day("Date")) AS days FROM full_months WHERE "Year" = 2001""")
def allocate_exact_with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant of the noisy fallback: days add up to the month, none is negative."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    months = clean.between_dates(windows.monthly_totals(dense), inputs.TEST_FROM,
                                 inputs.LAST_FULL_DAY_BEFORE).select(*PANEL_KEY, QTY)
    no_pattern = allocate.series_pattern(dense.filter(F.col(CATEGORY) == "Bus"), inputs.PATTERN_YEAR)
    days = allocate.allocate_exact(months.withColumn("month_total", F.col(QTY)), no_pattern)
    return days.groupBy(*SERIES, F.trunc(DATE, "MM").alias("month"), "month_total").agg(
        F.sum(QTY).alias("allocated"), F.count_if(F.col(QTY) < 0).alias("negative_days"),
        F.count(F.lit(1)).alias("days"))


@query("I2", f"""SELECT {KEY_SQL}, CAST(trunc(total * coalesce(w, 1.0 / len)) AS BIGINT) AS "Predicted_Sales" FROM ({DAYS_2001}) a
LEFT JOIN (SELECT c AS "Vehicle_Category", m, d, coalesce(q / nullif(sum(q) OVER (PARTITION BY c, m), 0), 1 / 30.0) AS w FROM (
SELECT "Vehicle_Category" AS c, month("Date") AS m, day("Date") AS d, sum({Q}) AS q FROM panel_dense
WHERE year("Date") <= 2000 AND "Vehicle_Category" <> 'Bus' GROUP BY 1, 2, 3)) p USING ("Vehicle_Category")
WHERE p.m IS NULL OR (p.m = month("Date") AND p.d = day("Date"))""")
def allocate_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category pattern; Bus has none and gets 1/days."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    months = clean.between_dates(windows.monthly_totals(dense), inputs.TEST_FROM, inputs.LAST_FULL_DAY_BEFORE)
    pattern = allocate.category_pattern(dense.filter(F.col(CATEGORY) != "Bus"), 2000)
    return allocate.allocate_by_pattern(months.withColumnRenamed(QTY, PRED), pattern)


@query("I3,I6", f"""SELECT {KEY_SQL}, CAST(trunc(total / len) AS BIGINT) AS "Predicted_Sales" FROM ({DAYS_2001})
WHERE "Date" BETWEEN DATE '2001-02-10' AND DATE '2001-05-20'""")
def allocate_evenly_within_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = clean.between_dates(inputs.full_months(spark, sf_dir), start=inputs.TEST_FROM)
    days = allocate.allocate_evenly(months.withColumnRenamed(QTY, PRED))
    return allocate.within_horizon(days, "2001-02-10", "2001-05-20")
