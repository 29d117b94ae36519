"""Join, aggregation, set and duplicate-handling queries on the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, r6, rounded
from saleloom.operators import (
    allocate,
    clean,
    densify,
    encode,
    merge,
    summary,
    windows,
)
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, SERIES, STATE
from saleloom.session import cut_lineage, stored

DATE_TEXT = 'CAST("Date" AS VARCHAR) AS "Date"'
KEY_SQL = f'{DATE_TEXT}, "State", "Vehicle_Category"'

# ---- joins ---------------------------------------------------------------------


@query("C1,F18,G7,G8", f"""SELECT {KEY_SQL},
round(avg(q) OVER (PARTITION BY "State", "Date"), 6) AS state_daily_mean,
round(avg(q) OVER (PARTITION BY "State"), 6) AS state_overall_mean,
round(avg(q) OVER (PARTITION BY "Vehicle_Category"), 6) AS category_overall_mean,
round(avg(q) OVER (PARTITION BY "State") * avg(q) OVER (PARTITION BY "Vehicle_Category"), 6)
  AS state_category_interaction,
round(q / (avg(q) OVER (PARTITION BY "State", "Date") + 1), 6) AS sales_ratio_to_state_mean,
round(q / (avg(q) OVER (PARTITION BY "Vehicle_Category") + 1), 6) AS sales_ratio_to_category_mean
FROM (SELECT *, "EV_Sales_Quantity" AS q FROM panel_dense)""")
def group_mean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.add_ratios(windows.add_group_means(inputs.stored_dense(spark, sf_dir)))
    return rounded(df.drop(QTY))


@query("G7,G8", f"""SELECT {KEY_SQL},
round(m * c, 6) AS daily_interaction, round(q / (m + 1e-8), 6) AS ratio_to_state,
round(q / (c + 1e-8), 6) AS ratio_to_category
FROM (SELECT *, "EV_Sales_Quantity" AS q, avg("EV_Sales_Quantity") OVER (PARTITION BY "State", "Date") AS m,
avg("EV_Sales_Quantity") OVER (PARTITION BY "Vehicle_Category") AS c FROM panel)""")
def group_ratio_small_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental trainer's form: state-day mean in the product, +1e-8."""
    df = windows.add_group_means(inputs.stored_panel(spark, sf_dir))
    df = windows.add_ratios(df, offset=1e-8)
    return rounded(df.select(
        *PANEL_KEY, (F.col("state_daily_mean") * F.col("category_overall_mean"))
        .alias("daily_interaction"), F.col("sales_ratio_to_state_mean").alias("ratio_to_state"),
        F.col("sales_ratio_to_category_mean").alias("ratio_to_category")))


@query("C2", f"""SELECT {KEY_SQL}, round(w, 6) AS weight FROM
(SELECT * FROM panel WHERE year("Date") = 2001)
LEFT JOIN (SELECT "State", "Vehicle_Category", month("Date") AS m, day("Date") AS d,
 "EV_Sales_Quantity" / sum("EV_Sales_Quantity") OVER (PARTITION BY "State", "Vehicle_Category", month("Date")) AS w
 FROM panel_dense WHERE year("Date") = 2000) p USING ("State", "Vehicle_Category")
WHERE p.m IS NULL OR (p.m = month("Date") AND p.d = day("Date"))""")
def daily_weight_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.stored_panel(spark, sf_dir)
    pattern = allocate.series_pattern(densify.dense_calendar(panel), inputs.PATTERN_YEAR)
    rows = panel.filter(F.year(DATE) == 2001).withColumns(
        {"month": F.month(DATE), "day": F.dayofmonth(DATE)})
    return (rows.join(pattern, [*SERIES, "month", "day"], "left")
            .select(*PANEL_KEY, r6("weight").alias("weight")))


@query("C3,I4", f"""SELECT CAST(p."Date" AS VARCHAR) AS "Date", p."State", p."Vehicle_Category",
m.q AS monthly, CAST(trunc(coalesce(m.q / 30.0, 0)) AS BIGINT) AS "Predicted_Sales"
FROM panel p LEFT JOIN (SELECT "State", "Vehicle_Category", date_trunc('month', "Date") AS mm,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS q
FROM panel WHERE "Vehicle_Category" <> 'Others' GROUP BY ALL) m
ON p."State" = m."State" AND p."Vehicle_Category" = m."Vehicle_Category" AND date_trunc('month', p."Date") = m.mm""")
def month_onto_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.stored_panel(spark, sf_dir)
    monthly = (windows.monthly_totals(panel.filter(F.col(CATEGORY) != "Others"))
               .withColumnRenamed(QTY, "monthly"))
    days = allocate.month_onto_days(panel, monthly, "monthly")
    return days.select(*PANEL_KEY, "monthly",
                       F.coalesce((F.col("monthly") / 30).cast("long"), F.lit(0)).alias(PRED))


@query("C4,H4", f"""SELECT {KEY_SQL}, round(coalesce(m, (SELECT avg("EV_Sales_Quantity") FROM panel
WHERE "Date" < DATE '2000-06-01' AND "State" <> 'NATION_3')), 6) AS state_encoded
FROM panel LEFT JOIN (SELECT "State", avg("EV_Sales_Quantity") AS m FROM panel
WHERE "Date" < DATE '2000-06-01' AND "State" <> 'NATION_3' GROUP BY 1) USING ("State")
WHERE "Date" >= DATE '2000-06-01'""")
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training means only; the state left out of training gets the overall mean."""
    panel = inputs.stored_panel(spark, sf_dir)
    train = clean.between_dates(panel, before=inputs.TRAIN_BEFORE).filter(F.col(STATE) != "NATION_3")
    later = clean.between_dates(panel, start=inputs.TRAIN_BEFORE)
    return encode.target_encode(later, train, [STATE]).select(
        *PANEL_KEY, r6("state_encoded").alias("state_encoded"))


@query("C5", """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS "Date", "State", "Vehicle_Category" FROM
(SELECT DISTINCT "State", "Vehicle_Category" FROM panel)
CROSS JOIN (SELECT unnest(generate_series(DATE '2001-08-02', DATE '2001-10-30', INTERVAL 1 DAY)) AS d)""")
def forecast_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = merge.distinct_series(inputs.panel(spark, sf_dir))
    return densify.forecast_spine(series, "2001-08-02", 90)


@query("C5", """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS "Date", "State", "Vehicle_Category" FROM
(SELECT DISTINCT "State", "Vehicle_Category" FROM panel)
CROSS JOIN (SELECT unnest(generate_series(DATE '2001-08-01', DATE '2002-07-01', INTERVAL 1 MONTH)) AS d)""")
def forecast_spine_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = merge.distinct_series(inputs.panel(spark, sf_dir))
    return densify.month_spine(series, "2001-08-01", 12)


@query("C6", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel_dense""")
def dense_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.dense(spark, sf_dir)


@query("C7", f"""SELECT {KEY_SQL}, CAST("Date" IN (SELECT "Date" FROM holidays) AS INTEGER) AS is_holiday
FROM panel""")
def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = densify.mark_holidays(inputs.panel(spark, sf_dir), inputs.holidays(spark))
    return marked.select(*PANEL_KEY, "is_holiday")


RUN_A = """SELECT "Vehicle_Category", "EV_Sales_Quantity" AS y, "Predicted_Sales" AS p FROM predictions
WHERE "Date" >= DATE '2001-01-01' AND "Vehicle_Category" <> 'Bus'"""
RUN_B = """SELECT "Vehicle_Category", "EV_Sales_Quantity" AS y, m AS p FROM (SELECT *,
avg(CASE WHEN "Date" < DATE '2001-01-01' THEN "EV_Sales_Quantity" END) OVER (PARTITION BY "State", "Vehicle_Category") AS m FROM panel_dense)
WHERE "Date" >= DATE '2001-01-01' AND "Vehicle_Category" <> 'Others'"""


@query("C8,E8,K12", f"""SELECT "Vehicle_Category", round(a.mae, 6) AS mae_a, round(a.r2, 6) AS r2_a,
round(b.mae, 6) AS mae_b, round(b.r2, 6) AS r2_b,
CASE WHEN b.mae IS NULL OR a.mae < b.mae THEN 'a' WHEN a.mae IS NULL OR b.mae < a.mae THEN 'b' ELSE 'tie' END AS mae_winner,
CASE WHEN b.r2 IS NULL OR a.r2 > b.r2 THEN 'a' WHEN a.r2 IS NULL OR b.r2 > a.r2 THEN 'b' ELSE 'tie' END AS r2_winner
FROM (SELECT "Vehicle_Category", avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
      FROM ({RUN_A}) GROUP BY 1) a
FULL JOIN (SELECT "Vehicle_Category", avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
      FROM ({RUN_B}) GROUP BY 1) b USING ("Vehicle_Category")""")
def compare_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing mean against series mean; each run lacks one category."""
    predictions = stored(inputs.predictions(spark, sf_dir), "predictions")
    test = clean.between_dates(predictions, start=inputs.TEST_FROM)
    history = clean.between_dates(predictions, before=inputs.TEST_FROM)
    run_b = summary.mean_predictor(test.drop(PRED), history).filter(F.col(CATEGORY) != "Others")
    return rounded(summary.compare_runs(test.filter(F.col(CATEGORY) != "Bus"), run_b))


@query("C9,G11,K21", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" AS actual,
round("Predicted_Sales", 6) AS predicted, round("EV_Sales_Quantity" - "Predicted_Sales", 6) + 0 AS residual,
round(abs("EV_Sales_Quantity" - "Predicted_Sales"), 6) AS error,
round(abs("EV_Sales_Quantity" - "Predicted_Sales") * 100.0 / nullif("EV_Sales_Quantity", 0), 6) AS percent_error
FROM predictions WHERE "Date" >= DATE '2001-01-01'""")
def residual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions kept apart are joined back to the actuals by key."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    rows = clean.between_dates(inputs.trailing_predictions(dense), start=inputs.TEST_FROM)
    kept_apart = rows.select(*PANEL_KEY, PRED)
    actuals = clean.between_dates(dense, start=inputs.TEST_FROM)
    return rounded(summary.residuals(actuals.join(kept_apart, PANEL_KEY)))


MODELLED = ["2-Wheelers", "4-Wheelers", "Others"]


@query("C10", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel
WHERE "Vehicle_Category" IN ('2-Wheelers', '4-Wheelers', 'Others')""")
def keep_modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose category has a model; the registry lists fitted models."""
    registry = spark.createDataFrame([(c,) for c in MODELLED], f"{CATEGORY} string")
    return inputs.panel(spark, sf_dir).join(F.broadcast(registry), CATEGORY, "left_semi")


@query("C10", """SELECT "Vehicle_Category", count(*) AS rows_skipped FROM panel
WHERE "Vehicle_Category" NOT IN ('2-Wheelers', '4-Wheelers', 'Others') GROUP BY 1""")
def skipped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([(c,) for c in MODELLED], f"{CATEGORY} string")
    skipped = inputs.panel(spark, sf_dir).join(F.broadcast(registry), CATEGORY, "left_anti")
    return skipped.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("rows_skipped"))


# ---- aggregates ----------------------------------------------------------------


@query("D1", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel""")
def sum_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.panel(spark, sf_dir)


@query("D2", f"""SELECT {KEY_SQL}, "Year", "Month", "EV_Sales_Quantity" FROM (
SELECT "State", "Vehicle_Category", CAST(date_trunc('month', "Date") AS DATE) AS "Date", year("Date") AS "Year",
month("Date") AS "Month", CAST(sum("EV_Sales_Quantity") AS BIGINT) AS "EV_Sales_Quantity" FROM clean_sales GROUP BY 1, 2, 3, 4, 5)""")
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight from sales rows: one shuffle, no daily panel in between."""
    return windows.monthly_totals(inputs.clean_sales(spark, sf_dir))


@query("D3", """SELECT "State", strftime("Date", '%Y-%m') AS year_month,
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS "EV_Sales_Quantity", CAST(min("Date") AS VARCHAR) AS first_date
FROM panel WHERE "Vehicle_Category" = '3-Wheelers' AND "Date" < DATE '2001-01-01' GROUP BY 1, 2""")
def monthly_one_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.between_dates(inputs.panel(spark, sf_dir), before=inputs.TEST_FROM)
    return (rows.filter(F.col(CATEGORY) == "3-Wheelers")
            .groupBy(STATE, F.date_format(F.trunc(DATE, "MM"), "yyyy-MM").alias("year_month"))
            .agg(F.sum(QTY).alias(QTY), F.min(DATE).alias("first_date")))


@query("D4", """SELECT "Vehicle_Category", CAST(date_trunc('month', "Date") AS DATE)::VARCHAR AS "Date",
year("Date") AS "Year", month("Date") AS "Month",
CAST(sum("EV_Sales_Quantity") AS BIGINT) AS "EV_Sales_Quantity" FROM clean_sales GROUP BY 1, 2, 3, 4""")
def monthly_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.monthly_totals(inputs.clean_sales(spark, sf_dir), [CATEGORY])


@query("D5", """SELECT CAST("Date" AS VARCHAR) AS "Date", CAST(sum("EV_Sales_Quantity") AS BIGINT) AS actual,
round(sum("Predicted_Sales"), 6) AS predicted FROM predictions GROUP BY 1""")
def national_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.national_by_date(inputs.predictions(spark, sf_dir)))


@query("D6,F19", """SELECT "Vehicle_Category", m AS month, d AS day,
round(coalesce(q / nullif(sum(q) OVER (PARTITION BY "Vehicle_Category", m), 0), 1 / 30.0), 6) AS weight FROM (
SELECT "Vehicle_Category", month("Date") AS m, day("Date") AS d, sum("EV_Sales_Quantity") AS q FROM (
SELECT "Vehicle_Category", "Date", CASE WHEN "Vehicle_Category" = 'Bus' AND month("Date") = 2 THEN 0 ELSE "EV_Sales_Quantity" END
 AS "EV_Sales_Quantity" FROM panel_dense WHERE year("Date") <= 2000) GROUP BY 1, 2, 3)""")
def category_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weights by category; one month is emptied to show the 1/30 rule."""
    no_bus = (F.col(CATEGORY) == "Bus") & (F.month(DATE) == 2)
    df = inputs.dense(spark, sf_dir).withColumn(
        QTY, F.when(no_bus, F.lit(0)).otherwise(F.col(QTY)))
    return rounded(allocate.category_pattern(df, 2000))


@query("D7,F19", """SELECT "State", "Vehicle_Category", m AS month, d AS day, n AS days, round(q / t, 6) AS weight FROM (
SELECT "State", "Vehicle_Category", month("Date") AS m, day("Date") AS d, "EV_Sales_Quantity" AS q,
sum("EV_Sales_Quantity") OVER (PARTITION BY "State", "Vehicle_Category", month("Date")) AS t,
count(*) OVER (PARTITION BY "State", "Vehicle_Category", month("Date")) AS n
FROM panel_dense WHERE year("Date") = 2000) WHERE t > 0""")
def series_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocate.series_pattern(inputs.dense(spark, sf_dir), inputs.PATTERN_YEAR))


@query("D8", """SELECT "State", "Vehicle_Category", isodow("Date") - 1 AS day_of_week,
round(avg("EV_Sales_Quantity"), 6) AS mean_quantity FROM panel_dense WHERE "EV_Sales_Quantity" > 0 GROUP BY 1, 2, 3""")
def weekday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.weekday_profile(inputs.panel(spark, sf_dir)))


@query("D9", """SELECT "State", isodow("Date") - 1 AS day_of_week,
round(avg("EV_Sales_Quantity"), 6) AS mean_quantity FROM panel_dense GROUP BY 1, 2""")
def weekday_mean_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.weekday_profile(inputs.dense(spark, sf_dir), [STATE], positive_only=False))


RATE_SQL = """SELECT "State", "Vehicle_Category", CASE WHEN lvl < 1 THEN 5 ELSE lvl END AS daily_level FROM (
SELECT "State", "Vehicle_Category",
coalesce(avg("EV_Sales_Quantity") FILTER (WHERE "EV_Sales_Quantity" > 0 AND rp <= 30), avg("EV_Sales_Quantity") FILTER (WHERE ra <= 30)) AS lvl
FROM (SELECT *, row_number() OVER (PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" DESC) AS ra,
 row_number() OVER (PARTITION BY "State", "Vehicle_Category", "EV_Sales_Quantity" > 0 ORDER BY "Date" DESC) AS rp
 FROM panel_dense) GROUP BY 1, 2)"""


@query("D10", f"""SELECT k."State", k."Vehicle_Category", round(coalesce(r.daily_level, 10), 6) AS daily_level
FROM (SELECT DISTINCT "State", c AS "Vehicle_Category" FROM panel, (SELECT unnest(['Bus', 'Trucks']) AS c)) k
LEFT JOIN ({RATE_SQL}) r ON k."State" = r."State" AND k."Vehicle_Category" = r."Vehicle_Category\"""")
def run_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of one known and one unknown category per state."""
    dense = inputs.dense(spark, sf_dir)
    asked = dense.select(STATE).distinct().select(
        STATE, F.explode(F.array(F.lit("Bus"), F.lit("Trucks"))).alias(CATEGORY))
    return rounded(summary.level_or_default(asked, summary.run_rate(dense)))


@query("D11,K16", """(SELECT 'category' AS scope, "Vehicle_Category" AS name, round(t, 6) AS total FROM
 (SELECT "Vehicle_Category", sum("Predicted_Sales") AS t FROM predictions GROUP BY 1 ORDER BY t DESC, 1 LIMIT 3))
UNION ALL (SELECT 'state', "State", round(t, 6) FROM
 (SELECT "State", sum("Predicted_Sales") AS t FROM predictions GROUP BY 1 ORDER BY t DESC, 1 LIMIT 5))
UNION ALL (SELECT 'all', 'all', round(sum("Predicted_Sales"), 6) FROM predictions)""")
def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, top 5 states and top 3 categories from one pass over the rows."""
    totals = cut_lineage(summary.totals_with_subtotals(inputs.predictions(spark, sf_dir)))

    def top(scope: str, n: int) -> DataFrame:
        return totals.filter(F.col("scope") == scope).orderBy(F.col("total").desc(), "name").limit(n)
    
    return rounded(top("category", 3).unionByName(top("state", 5)).unionByName(top("all", 1)))


@query("D11", """SELECT "State", CAST(sum("EV_Sales_Quantity") AS BIGINT) AS total FROM panel
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 straight from the sales rows."""
    return summary.top_totals(inputs.clean_sales(spark, sf_dir), STATE, 10, QTY)


@query("D12", """SELECT "Vehicle_Category", count(*) AS records, round(avg("EV_Sales_Quantity"), 6) AS actual_mean,
round(stddev_samp("EV_Sales_Quantity"), 6) AS actual_std, round(avg("Predicted_Sales"), 6) AS predicted_mean,
round(stddev_samp("Predicted_Sales"), 6) AS predicted_std FROM predictions GROUP BY 1""")
def spread_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.spread_by_category(inputs.predictions(spark, sf_dir)))


@query("D13", """SELECT "Vehicle_Category", max("EV_Sales_Quantity") - min("EV_Sales_Quantity") AS actual_range,
round(max("Predicted_Sales") - min("Predicted_Sales"), 6) AS predicted_range FROM predictions GROUP BY 1""")
def range_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.range_by_category(inputs.predictions(spark, sf_dir)))


@query("D14", """SELECT "Vehicle_Category", count(DISTINCT v) AS distinct_values, CAST(min(v) = max(v) AS INTEGER) AS is_constant
FROM (SELECT "Vehicle_Category", CASE WHEN "Vehicle_Category" = 'Bus' THEN 3 ELSE CAST(trunc("Predicted_Sales") AS BIGINT) END AS v
FROM predictions) GROUP BY 1""")
def constant_prediction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = inputs.predictions(spark, sf_dir).withColumn(
        PRED, F.when(F.col(CATEGORY) == "Bus", 3).otherwise(F.col(PRED).cast("long")))
    return summary.constant_prediction_check(flat)


@query("D15", """SELECT round(min("Predicted_Sales"), 6) AS lowest, round(max("Predicted_Sales"), 6) AS highest,
round(avg("Predicted_Sales"), 6) AS mean, round(stddev_samp("Predicted_Sales"), 6) AS std FROM predictions""")
def prediction_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.prediction_range(inputs.predictions(spark, sf_dir)))


@query("D16", f"""SELECT {KEY_SQL}, round(coalesce(s.m, c.m), 6) AS "Predicted_Sales" FROM
(SELECT * FROM panel WHERE "Date" >= DATE '2001-01-01')
LEFT JOIN (SELECT "State", "Vehicle_Category", avg("EV_Sales_Quantity") AS m FROM panel
 WHERE "Date" < DATE '2001-01-01' AND "State" <> 'NATION_3' GROUP BY 1, 2) s USING ("State", "Vehicle_Category")
LEFT JOIN (SELECT "Vehicle_Category", avg("EV_Sales_Quantity") AS m FROM panel
 WHERE "Date" < DATE '2001-01-01' AND "State" <> 'NATION_3' GROUP BY 1) c USING ("Vehicle_Category")""")
def mean_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series mean, else category mean (one state has no history)."""
    panel = inputs.stored_panel(spark, sf_dir)
    history = clean.between_dates(panel, before=inputs.TEST_FROM).filter(F.col(STATE) != "NATION_3")
    test = clean.between_dates(panel, start=inputs.TEST_FROM)
    return rounded(summary.mean_predictor(test, history).select(*PANEL_KEY, PRED))


@query("D16,J6,K3", """SELECT "Vehicle_Category", count(*) AS records, round(avg(abs(q - m)), 6) AS mae,
round(1 - sum((q - m) * (q - m)) / (var_pop(q) * count(*)), 6) AS r2 FROM (SELECT *, CAST("EV_Sales_Quantity" AS DOUBLE) AS q,
avg("EV_Sales_Quantity") OVER (PARTITION BY "State", "Vehicle_Category") AS m FROM panel_dense) GROUP BY 1""")
def score_whole_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every panel row scored by the mean predictor: the published timing run."""
    dense = inputs.dense(spark, sf_dir)
    scored = summary.metrics(summary.mean_predictor(dense, dense), [CATEGORY])
    return rounded(scored.select(CATEGORY, "records", "mae", "r2"))


@query("D17", """SELECT CASE WHEN grouping("State") = 0 THEN 'state' WHEN grouping("Vehicle_Category") = 0 THEN 'category' ELSE 'all' END AS scope,
coalesce("State", "Vehicle_Category", 'all') AS name, round(sum("Predicted_Sales"), 6) AS total
FROM predictions GROUP BY GROUPING SETS (("State"), ("Vehicle_Category"), ())""")
def totals_with_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.totals_with_subtotals(inputs.predictions(spark, sf_dir)))


# ---- set operations and duplicates ------------------------------------------------


@query("E2", f"""SELECT {KEY_SQL}, CAST(sum(q) AS BIGINT) AS "EV_Sales_Quantity" FROM (
SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity" AS q FROM panel UNION ALL
SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity" FROM new_push) GROUP BY 1, 2, 3""")
def merge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = inputs.stored_sales(spark, sf_dir)
    return merge.merge_sum(merge.sum_by_key(sales), inputs.pushed(sales))


UPSERT_SQL = """SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity" FROM (
SELECT *, row_number() OVER (PARTITION BY "Date", "State", "Vehicle_Category" ORDER BY src DESC,
 l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, "EV_Sales_Quantity" DESC) AS rn FROM (
SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity", 0 AS src, NULL AS l_orderkey, NULL AS l_linenumber,
 NULL AS l_partkey, NULL AS l_suppkey FROM panel WHERE "Date" < DATE '2001-04-01'
UNION ALL SELECT "Date", "State", "Vehicle_Category", "EV_Sales_Quantity", 1, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM new_push)) WHERE rn = 1"""


@query("E3", f'SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM ({UPSERT_SQL})')
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = inputs.stored_sales(spark, sf_dir)
    master = merge.sum_by_key(clean.between_dates(sales, before="2001-04-01"))
    return merge.upsert_keep_last(master, inputs.pushed(sales), inputs.SOURCE_ORDER)


@query("E4", """SELECT DISTINCT "State", "Vehicle_Category" FROM panel""")
def distinct_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.distinct_series(inputs.clean_sales(spark, sf_dir))


@query("E5", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM (SELECT *, row_number() OVER
(PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" DESC) AS rn FROM panel) WHERE rn <= 60""")
def last_rows_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_n_per_series(inputs.panel(spark, sf_dir), 60)


@query("E6", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel
ORDER BY panel."Date" DESC, "State" DESC, "Vehicle_Category" DESC LIMIT 30""")
def last_rows_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.last_rows_of(inputs.panel(spark, sf_dir), 30)


@query("E7", f"""SELECT {KEY_SQL}, "EV_Sales_Quantity" FROM panel
ORDER BY "State", "Vehicle_Category", panel."Date\"""")
def sort_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.by_series_and_date(inputs.panel(spark, sf_dir))


@query("E8", """SELECT "Vehicle_Category" FROM panel WHERE "Date" < DATE '1996-01-01' AND "Vehicle_Category" <> 'Bus'
UNION SELECT "Vehicle_Category" FROM panel WHERE "Date" >= DATE '2001-01-01' AND "Vehicle_Category" <> 'Others'""")
def union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.stored_panel(spark, sf_dir)
    early = clean.between_dates(panel, before="1996-01-01").filter(F.col(CATEGORY) != "Bus")
    late = clean.between_dates(panel, start=inputs.TEST_FROM).filter(F.col(CATEGORY) != "Others")
    return early.select(CATEGORY).union(late.select(CATEGORY)).distinct()


@query("E9,G13", """SELECT "State", "Vehicle_Category", 90 AS length, greatest(90 - n, 0) AS padded,
round(h[90], 6) AS newest, round(h[1], 6) AS oldest, round(list_sum(h[84:90]) / 7, 6) AS mean_7,
round(list_sum(h) / 90, 6) AS mean_90, round(list_stddev_pop(h[61:90]), 6) AS std_30,
round(list_min(h[84:90]), 6) AS min_7, round(list_max(h[84:90]), 6) AS max_7, round(list_median(h[84:90]), 6) AS median_7 FROM (
SELECT "State", "Vehicle_Category", n, list_concat(list_resize(CAST([] AS DOUBLE[]), 90 - n, m), v) AS h FROM (
SELECT "State", "Vehicle_Category", count(*) AS n, list(CAST("EV_Sales_Quantity" AS DOUBLE) ORDER BY "Date") AS v, any_value(m) AS m FROM (
SELECT *, avg("EV_Sales_Quantity") OVER (PARTITION BY "State", "Vehicle_Category") AS m,
row_number() OVER (PARTITION BY "State", "Vehicle_Category" ORDER BY "Date" DESC) AS rn
FROM panel WHERE "Date" >= DATE '2001-01-01') WHERE rn <= 90 GROUP BY 1, 2))""")
def padded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 90 values, short histories padded with their mean, and figures of the tail."""
    from saleloom.plans.recursive import tail_figures
    recent = clean.between_dates(inputs.stored_panel(spark, sf_dir), start=inputs.TEST_FROM)
    means = recent.groupBy(*SERIES).agg(F.avg(QTY).alias("mean"))
    values = merge.recent_values(recent, 90).join(means, SERIES)
    h = merge.pad_front(F.col("history"), 90, F.col("mean"))
    df = values.select(*SERIES, F.size("history").alias("n"), h.alias("h"))
    return rounded(df.select(
        *SERIES, F.size("h").alias("length"), F.greatest(90 - F.col("n"), F.lit(0)).alias("padded"),
        F.element_at("h", -1).alias("newest"), F.element_at("h", 1).alias("oldest"),
        *tail_figures(F.col("h"), {"mean": [7, 90], "std": [30], "min": [7], "max": [7], "median": [7]})))
