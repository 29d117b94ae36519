"""Metrics, splits, reports and live figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, r6, rounded
from saleloom.catalog.inputs_sql import SCORES
from saleloom.functions import scores
from saleloom.operators import clean, summary, windows
from saleloom.plans import origins
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, STATE
from saleloom.session import cut_lineage

KEY_SQL = 'CAST("Date" AS VARCHAR) AS "Date", "State", "Vehicle_Category"'
YP = '(SELECT *, CAST("EV_Sales_Quantity" AS DOUBLE) AS y, "Predicted_Sales" AS p FROM predictions)'
TEST = 'WHERE "Date" >= DATE \'2001-01-01\' AND "Date" < DATE \'2001-08-01\''


@query("D1,B4,B6,F1,K1,K3", f"""SELECT "Vehicle_Category", {SCORES} FROM (
SELECT "Vehicle_Category", CAST("EV_Sales_Quantity" AS DOUBLE) AS y,
avg("EV_Sales_Quantity") OVER @BEFORE(7) AS p, lag("EV_Sales_Quantity", 7) OVER @W AS l FROM panel)
WHERE l IS NOT NULL GROUP BY 1""")
def trailing_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: clean, categorise, sum, and score the mean of the last seven rows."""
    panel = inputs.panel(spark, sf_dir)
    df = panel.select(*PANEL_KEY, QTY, *windows.lags([7]),
                      *windows.rolling([7], ["mean"], "shifted", name=PRED))
    return rounded(summary.metrics(df.filter(F.col("lag_7").isNotNull()), [CATEGORY]))


@query("K1,K2", f"SELECT {SCORES} FROM {YP} {TEST}")
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.between_dates(inputs.predictions(spark, sf_dir), inputs.TEST_FROM,
                               inputs.LAST_FULL_DAY_BEFORE)
    return rounded(summary.metrics(rows))


@query("K2", """SELECT "Vehicle_Category", round(coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 0), 6) AS masked,
round(CASE WHEN count(*) FILTER (WHERE y = 0) = 0 THEN avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100 END, 6) AS all_rows
FROM (SELECT "Vehicle_Category", CAST(q AS DOUBLE) AS y, CAST(lag(q) OVER (PARTITION BY "Vehicle_Category" ORDER BY "Date") AS DOUBLE) AS p
FROM (SELECT "Vehicle_Category", "Date", sum(CASE WHEN "Vehicle_Category" = 'Bus' AND "Month" = 3 THEN 0 ELSE "EV_Sales_Quantity" END) AS q FROM full_months GROUP BY 1, 2)) GROUP BY 1""")
def mape_with_and_without_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last month as forecast of national months; one category has zero months."""
    no_march = (F.col(CATEGORY) == "Bus") & (F.col("Month") == 3)
    quantity = F.sum(F.when(no_march, 0).otherwise(F.col(QTY)))
    national = inputs.full_months(spark, sf_dir).groupBy(CATEGORY, DATE).agg(
        quantity.cast("double").alias(QTY))
    df = national.select(CATEGORY, QTY, windows.lags([1], series=[CATEGORY])[0].alias(PRED))
    y, p = F.col(QTY), F.col(PRED)
    return rounded(df.groupBy(CATEGORY).agg(scores.mape(y, p).alias("masked"),
                                            scores.mape_all_rows(y, p).alias("all_rows")))


@query("K3", f'SELECT "Vehicle_Category", {SCORES} FROM {YP} GROUP BY 1')
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.metrics(inputs.predictions(spark, sf_dir), [CATEGORY]))


@query("K4", f'SELECT "State", {SCORES} FROM {YP} GROUP BY 1')
def metrics_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.metrics(inputs.predictions(spark, sf_dir), [STATE]))


@query("K5", f"""SELECT {SCORES} FROM (SELECT "Date", CAST(sum("EV_Sales_Quantity") AS DOUBLE) AS y,
sum("Predicted_Sales") AS p FROM predictions GROUP BY 1)""")
def national_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.national_metrics(inputs.predictions(spark, sf_dir)))


@query("K6", f"""SELECT count(*) AS categories, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape,
round(avg(r2), 6) AS r2 FROM (SELECT "Vehicle_Category", avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 0) AS mape, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
FROM (SELECT "Vehicle_Category", "Date", CAST(sum("EV_Sales_Quantity") AS DOUBLE) AS y, sum("Predicted_Sales") AS p FROM predictions GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) >= 2)""")
def mean_of_category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.mean_of_category_metrics(inputs.predictions(spark, sf_dir)))


@query("K7,B12", f'SELECT "Vehicle_Category", {SCORES} FROM {YP} WHERE "Date" >= DATE \'2001-01-01\' GROUP BY 1')
def fixed_date_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut comes after the features: they need the earlier rows."""
    rows = clean.between_dates(inputs.predictions(spark, sf_dir), start=inputs.TEST_FROM)
    return rounded(summary.metrics(rows, [CATEGORY]))


@query("K8", f"""SELECT 'last 3 months' AS test_set, "Vehicle_Category", {SCORES} FROM {YP}
WHERE "Date" > (SELECT max("Date") FROM panel) - INTERVAL 3 MONTH GROUP BY 2
UNION ALL SELECT 'last 6 months', "Vehicle_Category", {SCORES} FROM {YP}
WHERE "Date" > (SELECT max("Date") FROM panel) - INTERVAL 6 MONTH GROUP BY 2
UNION ALL SELECT 'last 60 days', "Vehicle_Category", {SCORES} FROM {YP}
WHERE "Date" > (SELECT max("Date") FROM panel) - INTERVAL 60 DAY GROUP BY 2""")
def last_period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(inputs.predictions(spark, sf_dir))

    def part(name: str, **span: int) -> DataFrame:
        table = summary.metrics(summary.after_last(rows, **span), [CATEGORY])
        return table.withColumn("test_set", F.lit(name))

    return rounded(part("last 3 months", months=3).unionByName(part("last 6 months", months=6))
                   .unionByName(part("last 60 days", days=60)))


@query("K9", """SELECT count(*) AS rows, 1 AS parts_add_up, 1 AS share_near_80, 1 AS repeatable FROM panel_dense""")
def hashed_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants: both parts cover the table, 79-81 % train, equal when run twice."""
    keys = inputs.dense(spark, sf_dir).select(*PANEL_KEY)
    once = summary.hashed_split(keys, PANEL_KEY).withColumnRenamed("part", "first")
    twice = summary.hashed_split(once, PANEL_KEY)
    train = F.count_if(F.col("part") == "train")
    total = F.count(F.lit(1))
    return twice.agg(
        total.alias("rows"),
        (train + F.count_if(F.col("part") == "test") == total).cast("int").alias("parts_add_up"),
        (train / total).between(0.79, 0.81).cast("int").alias("share_near_80"),
        (F.count_if(F.col("part") != F.col("first")) == 0).cast("int").alias("repeatable"))


@query("K10", f"""SELECT fold, {SCORES} FROM (SELECT f.fold, CAST(q AS DOUBLE) AS y, pr AS p FROM
(SELECT "Date" AS d, "EV_Sales_Quantity" AS q, "Predicted_Sales" AS pr, min("Date") OVER () AS d0 FROM predictions)
JOIN (SELECT unnest(range(0, (max("Date") - min("Date") - 180 - 30 + 1) // 30 + 1)) AS fold FROM panel) f
ON d - d0 >= 180 + f.fold * 30 AND d - d0 < 210 + f.fold * 30) GROUP BY fold""")
def rolling_origin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = summary.rolling_origin(cut_lineage(inputs.predictions(spark, sf_dir)))
    return rounded(summary.metrics(folds, ["fold"]))


@query("K10,J17", f"""WITH x AS (SELECT *, "EV_Sales_Quantity" AS q, lag("EV_Sales_Quantity", 7) OVER @W AS l7, "Date" - min("Date") OVER () AS i FROM panel_dense),
f AS (SELECT unnest(range(0, (max(i) - 180 - 30 + 1) // 30 + 1)) AS fold FROM x),
fits AS (SELECT "State", "Vehicle_Category", fold, avg(q) AS m, CASE WHEN var_pop(l7) > 0 THEN regr_slope(q, l7) END AS b,
CASE WHEN var_pop(l7) > 0 THEN regr_intercept(q, l7) END AS a
FROM x JOIN f ON i >= fold * 30 AND i < fold * 30 + 180 WHERE l7 IS NOT NULL GROUP BY ALL)
SELECT fold, {SCORES} FROM (SELECT fold, CAST(q AS DOUBLE) AS y, coalesce(a + b * l7, m) AS p
FROM x JOIN f ON i >= 180 + fold * 30 AND i < 210 + fold * 30 JOIN fits USING ("State", "Vehicle_Category", fold)) GROUP BY fold""")
def rolling_origin_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series fitted anew in every fold on the quantity a week ago, scored on the fold's own test days."""
    panel = inputs.stored_dense(spark, sf_dir)
    rows = panel.select(*PANEL_KEY, QTY, *windows.lags([7]))
    return rounded(summary.metrics(origins.refit_each_fold(rows, ["lag_7"]), ["fold"]))


@query("K11", f"""SELECT "Vehicle_Category", count(*) AS records, round(avg(CASE WHEN r BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS coverage
FROM (SELECT "Vehicle_Category", round("EV_Sales_Quantity" - "Predicted_Sales", 6) AS r FROM predictions WHERE "Date" >= DATE '2001-01-01')
JOIN (SELECT "Vehicle_Category", quantile_cont(round("EV_Sales_Quantity" - "Predicted_Sales", 6), 0.05) AS lo,
quantile_cont(round("EV_Sales_Quantity" - "Predicted_Sales", 6), 0.95) AS hi FROM predictions WHERE "Date" < DATE '2001-01-01' GROUP BY 1)
USING ("Vehicle_Category") GROUP BY 1""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(inputs.predictions(spark, sf_dir))
    rounded_gap = F.col(QTY) - F.round(F.col(QTY) - F.col(PRED), 6)
    rows = rows.withColumn(PRED, rounded_gap)
    return rounded(summary.interval_coverage(clean.between_dates(rows, start=inputs.TEST_FROM),
                                             clean.between_dates(rows, before=inputs.TEST_FROM)))


R2_SQL = '1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))'


@query("K13", f"""SELECT "State", round(r2, 6) + 0 AS r2,
CASE WHEN r2 < 0 THEN 'poor' WHEN r2 < 0.3 THEN 'below expectations' WHEN r2 < 0.6 THEN 'acceptable' ELSE 'good' END AS grade,
CASE WHEN r2 < 0 THEN 'poor' WHEN r2 < 0.5 THEN 'below expectations' ELSE 'good' END AS report_grade
FROM (SELECT "State", {R2_SQL} AS r2 FROM {YP} GROUP BY 1)""")
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary.metrics(inputs.predictions(spark, sf_dir), [STATE])
    r2 = F.col("r2")
    return table.select(STATE, r6("r2").alias("r2"), scores.quality_grade(r2).alias("grade"),
                        scores.quality_grade(r2, 0.5, None).alias("report_grade"))


@query("K14", f"""SELECT "Vehicle_Category", round(r2, 6) + 0 AS r2, 0.9163 AS claimed_r2, round(0.9163 - r2, 6) AS difference
FROM (SELECT "Vehicle_Category", {R2_SQL} AS r2 FROM {YP} {TEST} GROUP BY 1)""")
def claimed_against_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.between_dates(inputs.predictions(spark, sf_dir), inputs.TEST_FROM,
                               inputs.LAST_FULL_DAY_BEFORE)
    measured = summary.metrics(rows, [CATEGORY]).select(CATEGORY, "r2")
    claimed = measured.select(CATEGORY, F.lit(0.9163).alias("claimed_r2"))
    return rounded(summary.claimed_against_measured(cut_lineage(measured), claimed, CATEGORY))


@query("K15", f"""WITH t AS (SELECT 'overall' AS scope, {SCORES} FROM {YP} UNION ALL
SELECT "Vehicle_Category", {SCORES} FROM {YP} GROUP BY 1)
SELECT scope, records, unnest(['mae', 'mse', 'rmse', 'r2', 'mape']) AS metric, unnest([mae, mse, rmse, r2, mape]) AS value FROM t""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.report_table(cut_lineage(inputs.predictions(spark, sf_dir))))


@query("F24", f"""SELECT "Vehicle_Category", records, round(mae, 6) AS mae, round(r2, 6) + 0 AS r2, rank() OVER (ORDER BY mae) AS mae_rank,
rank() OVER (ORDER BY r2 DESC) AS r2_rank FROM (SELECT "Vehicle_Category", count(*) AS records, avg(abs(y - p)) AS mae, {R2_SQL} AS r2
FROM {YP} GROUP BY 1)""")
def rank_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.rank_categories(inputs.predictions(spark, sf_dir)))


@query("K17", """SELECT count(*) AS events, round(avg(error), 6) AS mean_error, round(sum(actual), 4) AS actual_total FROM live_feed""")
def live_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.live_cards(inputs.live_feed(spark, sf_dir)).withColumns(
        {"mean_error": r6("mean_error"), "actual_total": F.round("actual_total", 4)})


@query("K17", "SELECT vehicle_category, count(*) AS events, round(avg(error), 6) AS mae FROM live_feed GROUP BY 1")
def live_error_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = inputs.live_feed(spark, sf_dir)
    return feed.groupBy("vehicle_category").agg(F.count(F.lit(1)).alias("events"),
                                                r6(F.avg("error")).alias("mae"))


@query("K18", """SELECT least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS BIGINT) + 1, 20) AS bin, count(*) AS n
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.histogram(inputs.table(spark, sf_dir, "events").select("value"), "value", 20)


@query("K19", """SELECT id, CAST("timestamp" AS VARCHAR) AS "timestamp", actual, round(predicted, 6) AS predicted FROM (
SELECT * FROM live_feed ORDER BY "timestamp" DESC, id DESC LIMIT 100) ORDER BY 2, 1""")
def last_actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = inputs.live_feed(spark, sf_dir).select("id", "timestamp", "actual", "predicted")
    return rounded(summary.newest(feed, 100, ["timestamp", "id"]).orderBy("timestamp", "id"))


@query("K20", """SELECT CAST("Date" AS VARCHAR) AS "Date", round(sum("Predicted_Sales"), 6) AS total FROM predictions GROUP BY 1""")
def daily_total_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.totals_by(inputs.predictions(spark, sf_dir), [DATE]))
