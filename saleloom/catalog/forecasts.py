"""Forecast queries that need no trained trees, and model bookkeeping."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, rounded
from saleloom.catalog.features import WEIGHTS_2000
from saleloom.catalog.panel_ops import RATE_SQL
from saleloom.operators import allocate, clean, merge, summary, windows
from saleloom.plans import baselines, models, recursive
from saleloom.schema import CATEGORY, PANEL_KEY, PRED, QTY
from saleloom.session import cut_lineage

KEY_SQL = 'CAST("Date" AS VARCHAR) AS "Date", "State", "Vehicle_Category"'
Q = '"EV_Sales_Quantity"'


@query("J4", f"""SELECT "Vehicle_Category", count(*) AS records, count(*) >= 500 AS trainable FROM full_months
WHERE "Date" < DATE '2000-06-01' AND {Q} >= 150 GROUP BY 1""")
def minimum_data_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy training months per category against a minimum."""
    busy = clean.between_dates(inputs.full_months(spark, sf_dir), before=inputs.TRAIN_BEFORE)
    return models.trainable_categories(busy.filter(F.col(QTY) >= 150), 500)


@query("J8", f"""WITH t AS (SELECT "Vehicle_Category", CAST({Q} AS DOUBLE) AS y, a, (a + b) / 2 AS e FROM (SELECT *,
avg({Q}) OVER @BEFORE(30) AS a, avg({Q}) OVER @BEFORE(7) AS b FROM panel_dense) WHERE "Date" >= DATE '2001-01-01')
SELECT "Vehicle_Category", model, count(*) AS records, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT "Vehicle_Category", y, 'original' AS model, a AS p FROM t UNION ALL SELECT "Vehicle_Category", y, 'updated', e FROM t) GROUP BY 1, 2""")
def compare_original_and_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 30-day mean against its average with a 7-day mean, on the hold-out."""
    means = windows.rolling([7, 30], ["mean"], "shifted", name="m{n}")
    df = inputs.dense(spark, sf_dir).select(*PANEL_KEY, QTY, *means)
    df = clean.between_dates(df, start=inputs.TEST_FROM).select(
        CATEGORY, QTY, F.col("m30").alias("original"), ((F.col("m30") + F.col("m7")) / 2).alias("updated"))
    table = models.compare_predictions(df, ["original", "updated"], [CATEGORY])
    return rounded(table.select(CATEGORY, "model", "records", "mae", "r2"))


@query("J13", f"""WITH rate AS ({RATE_SQL}),
days AS (SELECT "State", "Vehicle_Category", CAST(trunc(daily_level * 30 * 1.05) AS BIGINT) AS total, mm, day(last_day(mm)) AS len,
 CAST(unnest(generate_series(mm, last_day(mm), INTERVAL 1 DAY)) AS DATE) AS "Date"
 FROM rate, (SELECT unnest([DATE '2001-08-01', DATE '2001-09-01', DATE '2001-10-01']) AS mm)),
share AS (SELECT a.*, round(total * CASE WHEN w.t > 0 AND w.n = a.len THEN w.q / w.t ELSE 1.0 / a.len END, 9) AS x FROM days a
 LEFT JOIN ({WEIGHTS_2000}) w ON w."State" = a."State" AND w."Vehicle_Category" = a."Vehicle_Category" AND w.m = month(a."Date") AND w.d = day(a."Date"))
SELECT {KEY_SQL}, v AS "Forecasted_Sales" FROM (SELECT *, CAST(floor(x) + CASE WHEN row_number() OVER (PARTITION BY "State", "Vehicle_Category", mm
 ORDER BY round(x - floor(x), 9) DESC, "Date") <= total - sum(floor(x)) OVER (PARTITION BY "State", "Vehicle_Category", mm) THEN 1 ELSE 0 END AS BIGINT) AS v FROM share)
WHERE "Date" BETWEEN DATE '2001-08-02' AND DATE '2001-10-30'""")
def run_rate_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 days from the day after the panel ends, on the weights of 2000."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    pattern = allocate.series_pattern(dense, inputs.PATTERN_YEAR)
    return baselines.run_rate_forecast(summary.run_rate(dense), pattern, "2001-08-02", 90, noise=False)


@query("J14", f"""SELECT CAST(d AS VARCHAR) AS "Date", "State", "Vehicle_Category", CAST(greatest(trunc(daily_level * pow(1 + 0.02 / 30, i)
 * CASE WHEN isodow(d) >= 6 THEN CAST(1.1 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END), 0) AS BIGINT) AS "Forecasted_Sales" FROM ({RATE_SQL}),
(SELECT i, CAST(DATE '2001-08-01' + CAST(i AS INTEGER) AS DATE) AS d FROM (SELECT unnest(range(1, 31)) AS i))""")
def statistical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.projection(summary.run_rate(inputs.dense(spark, sf_dir)), "2001-08-02", 30)


@query("J17", f"""SELECT {KEY_SQL}, {Q}, round(avg({Q}) OVER (PARTITION BY "State", "Vehicle_Category" ORDER BY "Date"
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS series_mean, lag({Q}, 1) OVER @W AS last_value, lag({Q}, 12) OVER @W AS last_season FROM full_months""")
def naive_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = inputs.full_months(spark, sf_dir).select(*PANEL_KEY, QTY)
    return rounded(baselines.naive(months, 12))


@query("J18", f"""SELECT "State", "Vehicle_Category", round(regr_slope(d, d1), 6) AS slope, round(regr_intercept(d, d1), 6) + 0 AS intercept FROM (
SELECT *, lag(d) OVER @W AS d1 FROM (SELECT *, {Q} - lag({Q}) OVER @W AS d FROM full_months)) GROUP BY 1, 2""")
def ar1_on_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.ar1_coefficients(inputs.full_months(spark, sf_dir)))


@query("J18,K2", """SELECT "Vehicle_Category", count(*) AS records, round(avg("EV_Sales_Quantity"), 6) AS target_mean, 1 AS all_forecast
FROM full_months WHERE "Date" >= DATE '2000-08-01' GROUP BY 1""")
def ar5_forecast_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 5, twelve months ahead from the training months, scored per category."""
    months = cut_lineage(inputs.full_months(spark, sf_dir).select(*PANEL_KEY, QTY))
    train = clean.between_dates(months, before="2000-08-01")
    forecast = baselines.ar_forecast(train, 12)
    scored = months.join(forecast.withColumnRenamed("forecast", PRED), PANEL_KEY)
    known = (F.count(PRED) == F.count(F.lit(1))).cast("int")
    return rounded(scored.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("records"), F.avg(QTY).alias("target_mean"), known.alias("all_forecast")))


@query("J9,J10,J11,E5,C5", """WITH RECURSIVE start AS (SELECT "State", "Vehicle_Category", list(CAST(q AS DOUBLE) ORDER BY "Date") AS h FROM (
SELECT *, "EV_Sales_Quantity" AS q, row_number() OVER (PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" DESC) AS rn FROM panel_dense)
WHERE rn <= 7 GROUP BY 1, 2),
steps AS (SELECT "State", "Vehicle_Category", 0 AS step, h, CAST(0 AS DOUBLE) AS v FROM start UNION ALL
SELECT "State", "Vehicle_Category", step + 1, list_append(h, p)[2:8], p FROM (SELECT *, greatest(h[7] / 4 + h[1] / 2 + 0.5, 0) AS p FROM steps WHERE step < 30))
SELECT CAST(CAST(DATE '2001-08-01' + step AS DATE) AS VARCHAR) AS "Date", "State", "Vehicle_Category", round(v, 6) AS "Predicted_Sales"
FROM steps WHERE step > 0""")
def recursive_loop_with_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step loop under a model whose recursion SQL can follow: lag_1/4 + lag_7/2 + 1/2."""
    fixed = SQLTransformer(statement="SELECT *, lag_1 / 4 + lag_7 / 2 + 0.5D AS prediction FROM __THIS__")
    state = cut_lineage(merge.recent_values(inputs.dense(spark, sf_dir), 7))
    h = F.col("history")
    known = {f"lag_{k}": recursive.back(h, k) for k in (1, 7)}
    return rounded(recursive.roll_forward(
        state, {recursive.ALL: PipelineModel([fixed])}, recursive.days_after("2001-08-02", 30),
        lambda _: known, lambda v: {"history": windows.tail(F.array_append("history", v), 7)}))


@query("J21", """SELECT "Vehicle_Category", CASE WHEN "Vehicle_Category" IN ('3-Wheelers', 'Bus') THEN 'monthly' ELSE 'daily' END AS family,
count(*) AS days, CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total FROM panel GROUP BY 1, 2""")
def route_to_model_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = models.route_categories(inputs.panel(spark, sf_dir), {"3-Wheelers": "monthly", "Bus": "monthly"})
    return routed.groupBy(CATEGORY, "family").agg(F.count(F.lit(1)).alias("days"), F.sum(QTY).alias("total"))
