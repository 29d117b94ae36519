"""Queries that train and apply models with the library's own settings.

No SQL can train trees, so these return what SQL can know, hold-out rows, targets and the
error of the series mean, next to invariants of the models, shown as 1 where they hold. The
same library functions run under fixed models, whose recursion SQL follows, in fixed.py.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.catalog.base import query, rounded
from saleloom.operators import allocate, clean, encode, merge, summary, windows
from saleloom.plans import models, ondemand, recursive
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, SERIES, STATE
from saleloom.session import cut_lineage, new_folder

VALID_FROM = inputs.TRAIN_BEFORE
NEXT_DAY, NEXT_MONTH = "2001-08-02", "2001-08-01"
DAILY = windows.DailySpec(mode="shifted", means_until=inputs.TEST_FROM)
# fixed values: categories with models of their own
MONTHLY_CATEGORIES = ["3-Wheelers", "Bus"]
# the daily models of the loops stop early on the validation dates
DAILY_SETTINGS = {**models.INCREMENTAL_SETTINGS, "stepSize": 0.1}


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(inputs.full_months(spark, sf_dir))


def _hybrid(months: DataFrame) -> DataFrame:
    return models.store_by_category(models.with_state_codes(windows.hybrid_monthly_features(months)))


def _specialised(months: DataFrame) -> DataFrame:
    """Leak-safe set; the target mean of the state comes from training rows."""
    df = windows.specialised_monthly_features(months, mode="shifted")
    return models.store_by_category(encode.target_encode(df, clean.between_dates(months, before=VALID_FROM), SERIES))


def _before(df: DataFrame) -> DataFrame:
    """Training rows, the last months of them marked for validation."""
    return clean.between_dates(df, before=inputs.TEST_FROM).withColumn(
        "is_valid", F.col(DATE) >= F.lit(VALID_FROM).cast("date"))


def _after(df: DataFrame) -> DataFrame:
    return clean.between_dates(df, start=inputs.TEST_FROM)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _checked(scored: DataFrame, history: DataFrame, **invariants: bool) -> DataFrame:
    """By category: hold-out rows, mean target, MAE of the series mean; what must hold of the scores."""
    plain = summary.mean_predictor(scored.withColumnRenamed(PRED, "model"), history)
    table = plain.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("records"), F.avg(QTY).alias("target_mean"),
        F.avg(F.abs(F.col(QTY) - F.col(PRED))).alias("mean_mae"),
        _holds(F.count("model") == F.count(F.lit(1))).alias("all_scored"),
        _holds(F.min("model") >= 0).alias("not_negative"))
    return rounded(table.withColumns({k: F.lit(int(v)) for k, v in invariants.items()}))


def _check_sql(source: str, where: str, *invariants: str, key: str = '"State", "Vehicle_Category"') -> str:
    """What ``_checked`` gives when all invariants hold."""
    extra = "".join(f", 1 AS {name}" for name in invariants)
    return f"""SELECT "Vehicle_Category", count(*) AS records, round(avg(q), 6) AS target_mean, round(avg(abs(q - m)), 6) AS mean_mae,
1 AS all_scored, 1 AS not_negative{extra} FROM (SELECT *, "EV_Sales_Quantity" AS q, avg(CASE WHEN "Date" < DATE '2001-01-01'
THEN "EV_Sales_Quantity" END) OVER (PARTITION BY {key}) AS m FROM {source}) WHERE "Date" >= DATE '2001-01-01' AND {where} GROUP BY 1"""


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Do two scorings agree on every row?"""
    both = a.join(b.withColumnRenamed(PRED, "_other"), keys, "full")
    return both.filter(F.coalesce(F.abs(F.col(PRED) - F.col("_other")), F.lit(1.0)) > 1e-9).isEmpty()


def _daily_rows(dense: DataFrame) -> DataFrame:
    df = models.with_state_codes(clean.zero_for_null_numbers(windows.daily_features(dense, DAILY)))
    return models.store_by_category(df)


@query("J1,A10,K7", _check_sql("panel_dense", "TRUE", "has_trees", "same_when_loaded"))
def hurdle_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier and tuned regressor per category, stopped on the validation dates, saved and loaded."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    rows = models.store_by_category(models.with_state_codes(models.hurdle_features(dense)))
    train, test, folder = _before(rows), _after(rows), new_folder(spark, "hurdles")
    def fit(category: str) -> models.Hurdle:
        return models.fit_hurdle(train.filter(F.col(CATEGORY) == category), models.HURDLE_FEATURES, "is_valid", grid=models.GRID)

    def score(hurdles: dict[str, models.Hurdle]) -> DataFrame:
        return cut_lineage(merge.union_all(*[
            h.score(test.filter(F.col(CATEGORY) == c)).select(*PANEL_KEY, QTY, PRED) for c, h in hurdles.items()]))

    fitted = models.fit_each(models.categories_with_enough(train), fit)
    for c, h in fitted.items():
        h.save(f"{folder}/{c}")
    loaded = {c: models.Hurdle.load(f"{folder}/{c}", h.regressor is not None) for c, h in fitted.items()}
    scored = score(fitted)
    return _checked(scored, _before(dense), has_trees=all(models.trees_of(h.classifier) > 0 for h in fitted.values()),
                    same_when_loaded=_same(scored.select(*PANEL_KEY, PRED), score(loaded).select(*PANEL_KEY, PRED), PANEL_KEY))


@query("J2,J5,H6,J4", _check_sql("full_months", "TRUE", "has_trees"))
def monthly_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid monthly models: grid on 2000-06..12, refit on all rows before 2001."""
    months = _months(spark, sf_dir)
    rows = _hybrid(months)
    fitted, _ = models.train_monthly(_before(rows), VALID_FROM)
    scored = fitted.score(_after(rows), [*PANEL_KEY, QTY])
    return _checked(cut_lineage(scored), _before(months),
                    has_trees=all(models.trees_of(m) > 0 for m in fitted.models.values()))


@query("J5", f"""SELECT "Vehicle_Category", {len(models.GRID)} AS trials, {len(models.GRID)} AS settings, 1 AS errors_known, 1 AS errors_positive
FROM full_months GROUP BY 1""")
def grid_search_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation error of every setting tried for every category, counted and checked."""
    rows = _hybrid(_months(spark, sf_dir))
    _, trials = models.train_monthly(_before(rows), VALID_FROM)
    table = spark.createDataFrame(trials, f"{CATEGORY} string, setting string, valid_mae double")
    return table.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).cast("int").alias("trials"), F.count_distinct("setting").cast("int").alias("settings"),
        _holds(F.count("valid_mae") == F.count(F.lit(1))).alias("errors_known"), _holds(F.min("valid_mae") > 0).alias("errors_positive"))


@query("J5", """SELECT "Vehicle_Category", round, CASE round WHEN 0 THEN 24 WHEN 1 THEN 8 ELSE 3 END AS settings,
CASE round WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 45 END AS trees, CASE round WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 1 END AS survivors,
1 AS errors_known, 1 AS best_survive, 1 AS came_through
FROM (SELECT DISTINCT "Vehicle_Category" FROM full_months), (SELECT unnest(range(3)) AS round)""")
def halving_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 settings for every category by successive halving: who was tried, with how many trees, and who went on."""
    rows = _before(_hybrid(_months(spark, sf_dir)))
    trials = []
    for category in models.categories_with_enough(rows):
        mine = rows.filter(F.col(CATEGORY) == category)
        _, tried = models.halving_search(mine, "is_valid", models.HYBRID_FEATURES, models.spread_settings(), seed=42)
        trials += [(category, *t) for t in tried]
    table = spark.createDataFrame(trials, f"{CATEGORY} string, round long, setting string, trees int, error double, survived boolean")
    worst = F.max(F.when(F.col("survived"), F.col("error")))
    rounds = table.groupBy(CATEGORY, "round").agg(
        F.count_distinct("setting").cast("int").alias("settings"), F.max("trees").alias("trees"),
        F.count_if("survived").cast("int").alias("survivors"), _holds(F.count("error") == F.count(F.lit(1))).alias("errors_known"),
        _holds(F.coalesce(worst <= F.min(F.when(~F.col("survived"), F.col("error"))), F.lit(True))).alias("best_survive"),
        F.array_sort(F.collect_list("setting")).alias("_tried"), F.array_sort(F.collect_list(F.when(F.col("survived"), F.col("setting")))).alias("_kept"))
    before = F.lag("_kept").over(Window.partitionBy(CATEGORY).orderBy("round"))
    return rounds.withColumn("came_through", _holds(F.coalesce(F.col("_tried") == before, F.lit(True)))).drop("_tried", "_kept")


@query("J3,H4,K8", _check_sql("full_months", """"Vehicle_Category" IN ('3-Wheelers', 'Bus')""", "has_trees"))
def specialised_monthly_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared loss for three-wheelers, absolute for buses, on the last months."""
    months = _months(spark, sf_dir).filter(F.col(CATEGORY).isin(MONTHLY_CATEGORIES))
    rows = _specialised(months)
    fitted = models.train_per_category(_before(rows), models.SPECIALISED_FEATURES, models.specialised_settings,
                                       validation="is_valid")
    scored = fitted.score(_after(rows), [*PANEL_KEY, QTY])
    return _checked(cut_lineage(scored), _before(months),
                    has_trees=all(models.trees_of(m) > 0 for m in fitted.models.values()))


@query("J6,C10,A10", """SELECT "Vehicle_Category", count(*) AS rows, CASE WHEN "Vehicle_Category" IN ('2-Wheelers', '4-Wheelers', 'Others')
THEN 'scored' ELSE 'skipped' END AS status, 1 AS same_when_loaded FROM full_months WHERE "Date" >= DATE '2001-01-01' GROUP BY 1""")
def batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models saved, loaded and applied by category; categories without one are listed."""
    rows = _hybrid(_months(spark, sf_dir))
    train = _before(rows).filter(F.col(CATEGORY).isin("2-Wheelers", "4-Wheelers", "Others"))
    fitted = models.train_per_category(train, models.HYBRID_FEATURES, models.MONTHLY_SETTINGS, scale=True, validation="is_valid")
    folder = new_folder(spark, "models")
    fitted.save(folder)
    loaded = models.ModelSet.load(folder, models.HYBRID_FEATURES, sorted(fitted.models))
    test = _after(rows)
    scored = cut_lineage(loaded.score(test, PANEL_KEY))
    same = _same(scored, fitted.score(test, PANEL_KEY), PANEL_KEY)
    counts = scored.groupBy(CATEGORY).agg(F.count(PRED).alias("rows"))
    return merge.union_all(counts.withColumn("status", F.lit("scored")), loaded.skipped(test).withColumn("status", F.lit("skipped"))
                           ).withColumn("same_when_loaded", F.lit(int(same)))


@query("J7,J8,K9", """SELECT m AS model, CAST(count(*) AS BIGINT) AS new_records, CAST(0.01 AS DOUBLE) AS learning_rate, 1 AS a_fifth_validates, 1 AS has_trees,
1 AS known_errors FROM panel_dense, (SELECT unnest(['original', 'updated', 'ensemble']) AS m) WHERE "Date" >= DATE '2001-01-01' GROUP BY 1""")
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old model on days before 2001, second model on the days of the push, average of both."""
    rows = models.with_state_codes(models.hurdle_features(inputs.dense(spark, sf_dir)))
    rows = models.store_by_category(rows)
    train = models.placed(_before(rows))
    old = models.fit_regressor(train, models.HURDLE_FEATURES, validation="is_valid", **DAILY_SETTINGS)
    train.unpersist()
    _, valid, history = models.incremental_update(old, _after(rows), models.HURDLE_FEATURES, "2001-08-01T00:00:00")
    folder = new_folder(spark, "training-history")
    history.write.mode("append").parquet(folder)
    table = models.compare_predictions(cut_lineage(valid), ["original", "updated", "ensemble"], [])
    past = spark.read.parquet(folder).first()
    share = F.col("records") / F.lit(past["new_records"])
    return rounded(table.select(
        "model", F.lit(past["new_records"]).alias("new_records"), F.lit(past["learning_rate"]).alias("learning_rate"),
        _holds(share.between(0.18, 0.22)).alias("a_fifth_validates"), F.lit(int(past["n_estimators"] > 0)).alias("has_trees"),
        _holds(F.col("mae") >= 0).alias("known_errors")))


def _forecast_checks(forecast: DataFrame, value: str = PRED) -> DataFrame:
    return forecast.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(STATE).alias("states"), F.min(DATE).cast("string").alias("first_day"),
        F.max(DATE).cast("string").alias("last_day"), _holds(F.min(value) >= 0).alias("not_negative"))


def _forecast_sql(days: int, first: str, where: str = "TRUE") -> str:
    return f"""SELECT "Vehicle_Category", CAST(count(DISTINCT "State") * {days} AS BIGINT) AS rows, count(DISTINCT "State") AS states,
'{first}' AS first_day, CAST(CAST(DATE '{first}' + {days - 1} AS DATE) AS VARCHAR) AS last_day, 1 AS not_negative FROM panel_dense WHERE {where} GROUP BY 1"""


@query("J9,I2,D6,C5", _forecast_sql(365, NEXT_MONTH))
def recursive_monthly_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months ahead for all series, then days by the category pattern."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    months = cut_lineage(clean.between_dates(windows.monthly_totals(dense), before=inputs.LAST_FULL_DAY_BEFORE))
    codes = cut_lineage(encode.code_table(months, STATE))
    rows = models.store_by_category(encode.apply_codes(windows.hybrid_monthly_features(months), codes, STATE))
    fitted, _ = models.train_monthly(rows, inputs.TEST_FROM)
    forecast = recursive.forecast_months(months, codes, fitted.models, NEXT_MONTH, 12)
    pattern = allocate.category_pattern(dense, inputs.PATTERN_YEAR)
    return _forecast_checks(allocate.allocate_by_pattern(forecast, pattern))


def _fit_daily(rows: DataFrame) -> models.ModelSet:
    return models.train_per_category(rows, recursive.daily_columns(DAILY), DAILY_SETTINGS, validation="is_valid")


@query("J10,C5", _forecast_sql(90, NEXT_DAY))
def recursive_daily_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ninety days ahead for all series, the group means frozen."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    fitted = _fit_daily(_before(_daily_rows(dense)))
    return _forecast_checks(recursive.forecast_days(dense, fitted.models, DAILY, NEXT_DAY, 90))


@query("J11,E5,H3,H5,H8,H9,F3", _forecast_sql(30, NEXT_DAY))
def iterative_forecast_all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linear model for all series on scaled inputs; the last 60 rows are kept."""
    def fit(train: DataFrame, names: list[str], _: dict[str, DataFrame]) -> PipelineModel:
        linear = LinearRegression(featuresCol="x", labelCol=QTY, regParam=0.01)
        return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), linear]).fit(train)

    dense = cut_lineage(inputs.dense(spark, sf_dir))
    return _forecast_checks(recursive.forecast_all_series(dense, fit, NEXT_DAY, 30))


@query("J12,D8,E9,G13,J13,J14", f"""SELECT "Vehicle_Category", CAST(count(DISTINCT "State") * 30 AS BIGINT) AS rows, count(DISTINCT "State") AS states,
'{NEXT_DAY}' AS first_day, '2001-08-31' AS last_day, 1 AS not_negative, CASE WHEN "Vehicle_Category" IN ('3-Wheelers', 'Bus') THEN 'run rate'
WHEN "Vehicle_Category" = 'Others' THEN 'projection' ELSE 'model or projection' END AS source FROM panel_dense GROUP BY 1""")
def on_demand_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 days for all series: run rate, day loop or projection by category."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    rows = ondemand.training_rows(dense).filter(F.col(CATEGORY).isin("2-Wheelers", "4-Wheelers"))
    rows = models.store_by_category(rows).withColumn("is_valid", F.col(DATE) >= F.lit(inputs.TEST_FROM).cast("date"))
    fitted = models.train_per_category(rows, ondemand.model_columns(), DAILY_SETTINGS, validation="is_valid")
    out = ondemand.on_demand(dense, merge.distinct_series(dense), fitted.models, NEXT_DAY, 30, inputs.PATTERN_YEAR)
    out = cut_lineage(out)
    sources = out.groupBy(CATEGORY).agg(F.array_sort(F.collect_set("source")).alias("s"))
    allowed = F.when(F.forall("s", lambda x: x.isin("model", "projection")) & F.col(CATEGORY).isin("2-Wheelers", "4-Wheelers"),
                     "model or projection").otherwise(F.array_join("s", ","))
    return _forecast_checks(out, "Forecasted_Sales").join(sources.select(CATEGORY, allowed.alias("source")), CATEGORY)


@query("J15,I3,B14", _forecast_sql(365, NEXT_MONTH, """"Vehicle_Category" IN ('3-Wheelers', 'Bus')"""))
def direct_monthly_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months at once, every lag frozen at the last value, even days."""
    months = _months(spark, sf_dir).filter(F.col(CATEGORY).isin(MONTHLY_CATEGORIES))
    rows = _specialised(months)
    fitted = models.train_per_category(_before(rows), models.SPECIALISED_FEATURES, models.specialised_settings, validation="is_valid")
    return _forecast_checks(allocate.allocate_evenly(models.direct_forecast(rows, fitted, NEXT_MONTH, 12)))


@query("J16,C3,I4,J21", """SELECT "Vehicle_Category", count(*) AS records, round(avg("EV_Sales_Quantity"), 6) AS target_mean, 1 AS all_scored, 1 AS not_negative
FROM panel_dense GROUP BY 1""")
def back_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History scored by its own models: monthly ones a thirtieth a day, daily ones whole."""
    dense = cut_lineage(inputs.dense(spark, sf_dir))
    slow = dense.filter(F.col(CATEGORY).isin(MONTHLY_CATEGORIES))
    rows = _specialised(windows.monthly_totals(slow))
    fitted = models.train_per_category(_before(rows), models.SPECIALISED_FEATURES, models.specialised_settings, validation="is_valid")
    a = models.back_score_days(slow, rows, fitted)
    days = _daily_rows(dense.filter(~F.col(CATEGORY).isin(MONTHLY_CATEGORIES)))
    b = _fit_daily(_before(days)).score(days, [*PANEL_KEY, QTY])
    scored = a.unionByName(b.withColumn(PRED, F.col(PRED).cast("long")))
    return rounded(scored.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("records"), F.avg(QTY).alias("target_mean"), _holds(F.count(PRED) == F.count(F.lit(1))).alias("all_scored"),
        _holds(F.min(PRED) >= 0).alias("not_negative")))


@query("J19,F7", """SELECT "Vehicle_Category", count(*) AS records, round(avg(q), 6) AS target_mean, 1 AS all_scored, 1 AS not_negative FROM (
SELECT "Vehicle_Category", "Date", sum("EV_Sales_Quantity") AS q, row_number() OVER (PARTITION BY "Vehicle_Category" ORDER BY "Date" DESC) AS rn
FROM full_months GROUP BY 1, 2) WHERE rn <= 12 GROUP BY 1""")
def boosting_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National months per category, five features, the last twelve rows as test."""
    national = _months(spark, sf_dir).groupBy(CATEGORY, DATE).agg(F.sum(QTY).alias(QTY))
    _, scored = models.boosting_benchmark(national)
    return rounded(scored.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("records"), F.avg(QTY).alias("target_mean"), _holds(F.count(PRED) == F.count(F.lit(1))).alias("all_scored"),
        _holds(F.min(PRED) >= 0).alias("not_negative")))


@query("J20", f"""SELECT {min(10, len(models.HYBRID_FEATURES))} AS top_rows, 1 AS shares_sum_to_one, 1 AS known_names, 1 AS falling, 1 AS temporal_share_inside
FROM full_months LIMIT 1""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten features of one model and the share of the temporal ones, checked."""
    rows = models.placed(_before(_hybrid(_months(spark, sf_dir))))
    model: PipelineModel = models.fit_regressor(rows, models.HYBRID_FEATURES, validation="is_valid", **models.MONTHLY_SETTINGS)
    rows.unpersist()
    table = models.importance_table(spark, model, models.HYBRID_FEATURES)
    total = table.agg(F.sum("importance").alias("all"), F.sum(F.when(F.col("temporal"), F.col("importance"))).alias("temporal"),
                      F.min("importance").alias("least")).first()
    top = table.orderBy(F.col("importance").desc(), "feature").limit(10)
    return top.agg(
        F.count(F.lit(1)).cast("int").alias("top_rows"), F.lit(int(abs(total["all"] - 1) < 1e-6)).alias("shares_sum_to_one"),
        _holds(F.min(F.col("feature").isin(models.HYBRID_FEATURES))).alias("known_names"),
        _holds(F.min("importance") >= total["least"]).alias("falling"),
        F.lit(int(0 <= total["temporal"] <= 1 + 1e-9)).alias("temporal_share_inside"))
