"""The forecasting functions of the library under fixed models, whose recursion SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, rounded
from saleloom.operators import clean, encode, merge, windows
from saleloom.plans import baselines, models, ondemand, recursive
from saleloom.plans.scorers import Linear
from saleloom.schema import CATEGORY, PANEL_KEY, QTY, SERIES, STATE
from saleloom.session import cut_lineage

NEXT_DAY, NEXT_MONTH = "2001-08-02", "2001-08-01"
Q = '"EV_Sales_Quantity"'
S = '"State", "Vehicle_Category"'


def _fixed(constant: float = 0.0, hot: dict[str, dict[int, float]] | None = None, **weights: float) -> Linear:
    return Linear(weights, constant, hot or {})


def _tail_sql(source: str, n: int) -> str:
    """The last n quantities of each series, oldest first."""
    return f"""SELECT {S}, list(CAST(q AS DOUBLE) ORDER BY "Date") AS h FROM (SELECT *, {Q} AS q,
row_number() OVER (PARTITION BY {S} ORDER BY "Date" DESC) AS rn FROM {source}) WHERE rn <= {n} GROUP BY ALL"""


def _ewma_state_sql(source: str, span: int) -> str:
    """Weighted sum and weight of the whole series."""
    d, a = 1 - 2 / (span + 1), 2 / (span + 1)
    return f"""SELECT {S}, sum({Q} * pow({d!r}, back)) AS s, (1 - pow({d!r}, count(*))) / {a!r} AS w FROM (
SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY "Date" DESC) - 1 AS back FROM {source}) GROUP BY ALL"""


@query("J9", f"""WITH RECURSIVE tails AS ({_tail_sql('full_months', 12)}), sums AS ({_ewma_state_sql('full_months', 3)}),
codes AS (SELECT "State", row_number() OVER (ORDER BY "State") - 1 AS code FROM (SELECT DISTINCT "State" FROM full_months)),
steps AS (SELECT {S}, code, 0 AS step, h, s, w, CAST(0 AS DOUBLE) AS v FROM tails JOIN sums USING ({S}) JOIN codes USING ("State")
UNION ALL SELECT {S}, code, step + 1, list_append(h, p)[2:13], p + 0.5 * s, 1 + 0.5 * w, p FROM (SELECT *, greatest(0.4 * h[12] + 0.1 * h[1]
 + 0.3 * (h[10] + h[11] + h[12]) / 3 + 0.1 * s / w + 0.05 * ((7 + step) % 12 + 1) + 0.01 * code, 0) AS p FROM steps WHERE step < 12))
SELECT CAST(CAST(DATE '2001-07-01' + to_months(CAST(step AS INTEGER)) AS DATE) AS VARCHAR) AS "Date", {S}, round(v, 6) AS "Predicted_Sales" FROM steps WHERE step > 0""")
def monthly_loop_under_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, rolling means, EWMA, calendar and state code of the monthly loop."""
    months = cut_lineage(inputs.full_months(spark, sf_dir))
    codes = cut_lineage(encode.code_table(months, STATE))
    model = _fixed(Lag_1=0.4, Lag_12=0.1, Roll_Mean_3=0.3, EWMA_3=0.1, Month=0.05, State_code=0.01)
    return rounded(recursive.forecast_months(months, codes, {recursive.ALL: model}, NEXT_MONTH, 12))


@query("J10", f"""WITH RECURSIVE tails AS ({_tail_sql('panel_dense', 90)}), sums AS ({_ewma_state_sql('panel_dense', 7)}),
sm AS (SELECT "State", avg({Q}) AS sm FROM panel_dense GROUP BY 1), cm AS (SELECT "Vehicle_Category", avg({Q}) AS cm FROM panel_dense GROUP BY 1),
steps AS (SELECT {S}, sm, cm, 0 AS step, h, s, w, CAST(0 AS DOUBLE) AS v FROM tails JOIN sums USING ({S}) JOIN sm USING ("State") JOIN cm USING ("Vehicle_Category")
UNION ALL SELECT {S}, sm, cm, step + 1, list_append(h, p)[2:91], p + 0.75 * s, 1 + 0.75 * w, p FROM (SELECT *, greatest(0.3 * h[90] + 0.1 * h[84] + 0.05 * h[1]
 + 0.2 * list_avg(h[84:90]) + 0.1 * s / w + 0.05 * list_max(h[77:90]) + 0.05 * list_median(h[61:90]) + 0.05 * sm + 0.02 * sm * cm
 + 0.02 * (isodow(DATE '2001-08-02' + CAST(step AS INTEGER)) - 1) + 0.01 * len(list_filter(h[61:90], lambda x: x > 0))
 + 0.1 * (list_avg(h[84:90]) - list_avg(h[83:89])) + 0.02 * h[90] / (cm + 1), 0) AS p FROM steps WHERE step < 30))
SELECT CAST(CAST(DATE '2001-08-01' + CAST(step AS INTEGER) AS DATE) AS VARCHAR) AS "Date", {S}, round(v, 6) AS "Predicted_Sales" FROM steps WHERE step > 0""")
def daily_loop_under_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, rolling figures, trend, EWMA, group means and ratio of the daily loop on the full feature set."""
    model = _fixed(lag_1=0.3, lag_7=0.1, lag_90=0.05, rolling_mean_7=0.2, ema_7=0.1, rolling_max_14=0.05, rolling_median_30=0.05,
                   state_overall_mean=0.05, state_category_interaction=0.02, day_of_week=0.02, sales_frequency_30d=0.01,
                   trend_7=0.1, sales_ratio_to_category_mean=0.02)
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    spec = windows.DailySpec(mode="shifted")
    return rounded(recursive.forecast_days(dense, {recursive.ALL: model}, spec, NEXT_DAY, 30))


@query("J11", f"""WITH RECURSIVE fit AS (SELECT *, CAST(month("Date") AS DOUBLE) AS mo, lag({Q}, 1) OVER @W AS l1, lag({Q}, 7) OVER @W AS l7 FROM panel_dense),
par AS (SELECT avg(mo) AS am, stddev_pop(mo) + 1e-6 AS dm, avg(l1) AS a1, stddev_pop(l1) + 1e-6 AS d1, avg(l7) AS a7, stddev_pop(l7) + 1e-6 AS d7,
 avg({Q}) AS aq, stddev_pop({Q}) + 1e-6 AS dq FROM fit WHERE l7 IS NOT NULL),
steps AS (SELECT {S}, 0 AS step, h, CAST(0 AS DOUBLE) AS v FROM ({_tail_sql('panel_dense', 60)})
UNION ALL SELECT {S}, step + 1, list_append(h, p)[2:61], p FROM (SELECT steps.*, trunc(greatest((0.5 * (h[60] - a1) / d1 + 0.3 * (h[54] - a7) / d7
 + 0.05 * (month(DATE '2001-08-02' + CAST(step AS INTEGER)) - am) / dm + CASE WHEN "Vehicle_Category" = 'Bus' THEN 0.21 ELSE 0.0 END
 + CASE WHEN "State" = 'NATION_3' THEN 0.13 ELSE 0.0 END) * dq + aq, 0)) AS p FROM steps, par WHERE step < 30))
SELECT CAST(CAST(DATE '2001-08-01' + CAST(step AS INTEGER) AS DATE) AS VARCHAR) AS "Date", {S}, v AS "Predicted_Sales" FROM steps WHERE step > 0""")
def all_series_loop_under_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling, one-hot names, lags and the way back to units of the loop over all series."""
    def fit(train: DataFrame, names: list[str], codes: dict[str, DataFrame]) -> Linear:
        code = {v: codes[c].filter(F.col(c) == v).first()[f"{c}_code"] for c, v in ((CATEGORY, "Bus"), (STATE, "NATION_3"))}
        hot = {f"{CATEGORY}_code": {code["Bus"]: 0.21}, f"{STATE}_code": {code["NATION_3"]: 0.13}}
        return _fixed(lag_1=0.5, lag_7=0.3, month=0.05, hot=hot)

    dense = cut_lineage(inputs.dense(spark, sf_dir))
    return recursive.forecast_all_series(dense, fit, NEXT_DAY, 30)


@query("J12", f"""WITH RECURSIVE sold AS ({_tail_sql('(SELECT * FROM panel_dense WHERE "EV_Sales_Quantity" > 0)', 90)}), days AS ({_tail_sql('panel_dense', 90)}),
prof AS (SELECT {S}, isodow("Date") - 1 AS wd, avg({Q}) AS m FROM panel_dense WHERE {Q} > 0 GROUP BY ALL),
fac AS (SELECT p.{S.replace(", ", ", p.")}, map_from_entries(list((wd, CASE WHEN o.m > 0 THEN p.m / o.m ELSE 1.0 END))) AS f
 FROM prof p JOIN (SELECT {S}, avg(m) AS m FROM prof GROUP BY ALL) o USING ({S}) GROUP BY ALL),
steps AS (SELECT days.{S.replace(", ", ", days.")}, f, 0 AS step, CASE WHEN len(sold.h) = 90 THEN sold.h ELSE days.h END AS h, CAST(0 AS DOUBLE) AS v
 FROM days LEFT JOIN sold USING ({S}) LEFT JOIN fac USING ({S}) WHERE "Vehicle_Category" IN ('2-Wheelers', '4-Wheelers', 'Others')
UNION ALL SELECT {S}, f, step + 1, list_append(h, p)[2:91], p FROM (SELECT *, trunc(round(trunc(round(greatest(0.5 * h[90] + 0.2 * h[84] + 0.35 * list_avg(h[77:90])
 + 0.1 * (isodow(DATE '2001-08-02' + CAST(step AS INTEGER)) - 1) + 0.5003, 0), 9))
 * coalesce(f[isodow(DATE '2001-08-02' + CAST(step AS INTEGER)) - 1], 1.0), 9)) AS p FROM steps WHERE step < 30)),
moving AS (SELECT {S} FROM steps WHERE step > 0 GROUP BY ALL HAVING stddev_pop(v) > 0)
SELECT CAST(CAST(DATE '2001-08-01' + CAST(step AS INTEGER) AS DATE) AS VARCHAR) AS "Date", {S}, CAST(v AS BIGINT) AS "Forecasted_Sales"
FROM steps JOIN moving USING ({S}) WHERE step > 0""")
def on_demand_loop_under_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rule, weekday factors, whole quantities and the rule against flat forecasts."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    asked = merge.distinct_series(dense).filter(F.col(CATEGORY).isin("2-Wheelers", "4-Wheelers", "Others"))
    model = _fixed(0.5003, lag_1=0.5, lag_7=0.2, rolling_mean_14=0.35, day_of_week=0.1)
    return ondemand.ml_forecast(dense, asked, {recursive.ALL: model}, NEXT_DAY, 30)


_SPECIAL_SQL = f"""SELECT *, {Q} AS q, coalesce(lag({Q}, 1) OVER @W, 0) AS l1, coalesce(lag({Q}, 12) OVER @W, 0) AS l12, coalesce(avg({Q}) OVER @BEFORE(3), 0) AS r3,
coalesce(avg({Q}) OVER (PARTITION BY {S} ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sa,
avg(CASE WHEN "Date" < DATE '2000-06-01' THEN {Q} END) OVER (PARTITION BY {S}) AS se FROM"""

def _special() -> models.ModelSet:
    model = _fixed(0.0137, lag_month_1=0.5, lag_month_12=0.25, roll_mean_3m=0.2, month=0.1, state_avg=0.01, state_encoded=0.05)
    return models.ModelSet(models.SPECIALISED_FEATURES, dict.fromkeys(["3-Wheelers", "Bus"], model))


def _special_rows(months: DataFrame) -> DataFrame:
    df = windows.specialised_monthly_features(months, mode="shifted")
    return models.store_by_category(encode.target_encode(df, clean.between_dates(months, before=inputs.TRAIN_BEFORE), SERIES))


@query("J15", f"""SELECT CAST(CAST(DATE '2001-08-01' + to_months(CAST(k AS INTEGER)) AS DATE) AS VARCHAR) AS "Date", {S},
round(greatest(0.75 * q + 0.2 * r3 + 0.1 * ((7 + k) % 12 + 1) + 0.01 * sa + 0.05 * se + 0.0137, 0), 6) AS "Predicted_Sales"
FROM ({_SPECIAL_SQL} full_months), (SELECT unnest(range(12)) AS k) WHERE "Date" = DATE '2001-07-01' AND "Vehicle_Category" IN ('3-Wheelers', 'Bus')""")
def direct_forecast_under_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lag frozen at the last quantity, the other history features at their last value."""
    months = cut_lineage(inputs.full_months(spark, sf_dir)).filter(F.col(CATEGORY).isin("3-Wheelers", "Bus"))
    return rounded(models.direct_forecast(_special_rows(months), _special(), NEXT_MONTH, 12))


@query("J16", f"""SELECT CAST(d."Date" AS VARCHAR) AS "Date", d."State", d."Vehicle_Category", d.{Q}, CAST(trunc(greatest(0.5 * l1 + 0.25 * l12 + 0.2 * r3
 + 0.1 * month(m."Date") + 0.01 * sa + 0.05 * se + 0.0137, 0) / 30) AS BIGINT) AS "Predicted_Sales"
FROM panel_dense d JOIN ({_SPECIAL_SQL} monthly) m ON m."State" = d."State" AND m."Vehicle_Category" = d."Vehicle_Category"
 AND m."Date" = date_trunc('month', d."Date") WHERE d."Vehicle_Category" IN ('3-Wheelers', 'Bus')""")
def back_scores_under_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thirtieth of the month's prediction on each day of the history."""
    slow = cut_lineage(inputs.dense(spark, sf_dir)).filter(F.col(CATEGORY).isin("3-Wheelers", "Bus"))
    return models.back_score_days(slow, _special_rows(windows.monthly_totals(slow)), _special())


@query("J18", f"""SELECT "Vehicle_Category", count(*) AS series, 1 AS normal_equations FROM (SELECT DISTINCT {S} FROM full_months) GROUP BY 1""")
def ar5_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 5: the residuals of every series are orthogonal to each lag."""
    months = cut_lineage(inputs.full_months(spark, sf_dir).select(*PANEL_KEY, QTY))
    names = [f"d{k}" for k in range(1, 6)]
    rows = baselines.differences(months, 5).dropna(subset=["d", *names]).join(
        baselines.ar_coefficients(months, 5).select(*SERIES, "coefficients"), SERIES)
    fitted = sum((F.get("coefficients", F.lit(k)) * F.col(n) for k, n in enumerate(names)), F.lit(0.0))
    left = rows.withColumn("r", F.col("d") - fitted).groupBy(*SERIES).agg(
        F.greatest(*[F.abs(F.sum(F.col("r") * F.col(n))) for n in names]).alias("worst"), F.sum(F.col("d") * F.col("d")).alias("size"))
    return left.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("series"),
                                      F.min((F.col("worst") <= 1e-7 * F.col("size")).cast("int")).alias("normal_equations"))
