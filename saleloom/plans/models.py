"""Training, storing and scoring one model per category with Spark ML trees.

Trees stand in for the reference's boosting library; what carries over is the
protocol: leak-safe features, date splits, a grid on validation error, a refit on
all rows. The driver holds model metadata only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleloom.functions import calendar
from saleloom.operators import allocate, encode, summary, windows
from saleloom.operators.densify import month_spine
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, STATE
from saleloom.session import new_folder, stored

MIN_ROWS = 50
THREADS = 8
ROWS_PER_TASK = 20_000  # a tree level is one job; rows of one category rarely need many tasks

# ---- fixed values: feature lists ---------------------------------------------------
HURDLE_FEATURES = [
    "year", "month", "day", "quarter", "day_of_week", "week_of_year", "is_weekend", "State_code",
    "lag_1_day", "lag_7_days", "rolling_mean_7_days", "rolling_std_7_days",
    "rolling_mean_30_days", "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos"]
HYBRID_FEATURES = (
    ["Month", "Quarter", "Month_Sin", "Month_Cos"]
    + [f"Lag_{k}" for k in windows.MONTHLY_LAGS]
    + [f"Roll_{s}_{n}" for n in windows.MONTHLY_WINDOWS for s in ("Mean", "Std")]
    + [f"EWMA_{n}" for n in windows.MONTHLY_SPANS] + ["State_code"])
SPECIALISED_FEATURES = (
    ["month", "year", "quarter"] + [f"lag_month_{k}" for k in windows.MONTHLY_LAGS]
    + [f"roll_{s}_{n}m" for n in windows.MONTHLY_WINDOWS for s in ("mean", "std", "max")]
    + ["momentum", "state_avg", "state_encoded"])
BENCHMARK_FEATURES = ["month", "year", "lag_1", "lag_3", "rolling_mean_3"]

# ---- fixed values: model settings ---------------------------------------------------
HURDLE_CLASSIFIER = {"maxIter": 50, "seed": 42}
MONTHLY_SETTINGS = {"maxIter": 2000, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
                    "seed": 42}
THREE_WHEELER_SETTINGS = {"lossType": "squared", "maxIter": 1000, "stepSize": 0.03, "maxDepth": 5,
                          "subsamplingRate": 0.8, "seed": 42}
BUS_SETTINGS = {"lossType": "absolute", "maxIter": 1000, "stepSize": 0.03, "maxDepth": 5,
                "minInstancesPerNode": 15, "seed": 42}
INCREMENTAL_SETTINGS = {"stepSize": 0.01, "maxIter": 100, "seed": 42}
BENCHMARK_SETTINGS = {"maxIter": 50, "stepSize": 0.05, "maxDepth": 3, "seed": 42}
# tried by ``train_monthly``: rate, depth, leaf size and share of rows
GRID = [{"stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
        {"stepSize": 0.1, "maxDepth": 3, "minInstancesPerNode": 10, "subsamplingRate": 0.8},
        {"stepSize": 0.1, "maxDepth": 4, "minInstancesPerNode": 20, "subsamplingRate": 1.0}]


# ---- features -----------------------------------------------------------------------


def hurdle_features(panel: DataFrame) -> DataFrame:
    """Calendar, two lags and three shifted rolling figures; nulls are 0."""
    d = F.col(DATE)
    return panel.select(
        "*", *calendar.parts(d), *calendar.flags(d)[:1], *calendar.cyclical(d)[:4],
        *[c.alias(n) for c, n in zip(windows.lags([1, 7]), ["lag_1_day", "lag_7_days"])],
        *windows.rolling([7], ["mean", "std"], "shifted", name="rolling_{stat}_{n}_days"),
        *windows.rolling([30], ["mean"], "shifted", name="rolling_{stat}_{n}_days")).fillna(0)


def benchmark_features(monthly: DataFrame, series: list[str]) -> DataFrame:
    """Five features of a monthly series; rows without a full history go."""
    d = F.col(DATE)
    return (monthly.drop("Year", "Month")
            .select("*", F.month(d).alias("month"), F.year(d).alias("year"),
                    *windows.lags([1, 3], series=series),
                    windows.full_window_mean(3, series=series).alias("rolling_mean_3")).dropna())


def last_rows_split(df: DataFrame, n: int, series: list[str]) -> DataFrame:
    """Mark the newest n rows of each series as test."""
    newest = F.row_number().over(windows.series_window(series).orderBy(F.col(DATE).desc()))
    return df.withColumn("is_test", newest <= n)


def trainable_categories(train: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    """Rows per category and whether they suffice for a model."""
    return (train.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("records"))
            .withColumn("trainable", F.col("records") >= minimum))


def categories_with_enough(train: DataFrame, minimum: int = MIN_ROWS) -> list[str]:
    """Names of the categories to train; one short row each, so they fit the driver."""
    rows = trainable_categories(train, minimum).filter("trainable").select(CATEGORY).collect()
    return sorted(r[0] for r in rows)


# ---- fitting ------------------------------------------------------------------------


def placed(rows: DataFrame) -> DataFrame:
    """Rows kept in memory in few partitions: as many as their number asks for."""
    return rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK))).persist()


def store_by_category(df: DataFrame, name: str = "features") -> DataFrame:
    """Features written once, a folder per category, so that each model reads its own rows."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(CATEGORY).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trees_of(model: PipelineModel) -> int:
    """Trees that boosting kept."""
    return model.stages[-1].getNumTrees


def fit_regressor(train: DataFrame, features: list[str], label: str = QTY, scale: bool = False,
                  validation: str | None = None, **settings) -> PipelineModel:
    """Assembler, optional robust scaler, boosted trees.

    ``validation`` names a boolean column; its rows stop the boosting early.
    """
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features")]
    if scale:
        stages.append(RobustScaler(inputCol="raw_features", outputCol="features",
                                   withCentering=True, withScaling=True))
    source = "features" if scale else "raw_features"
    trees = GBTRegressor(featuresCol=source, labelCol=label, predictionCol="prediction", **settings)
    if validation:
        trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*stages, trees]).fit(train)


def fit_classifier(train: DataFrame, features: list[str], label: str,
                   validation: str | None = None, **settings) -> PipelineModel:
    trees = GBTClassifier(featuresCol="class_features", labelCol=label,
                          predictionCol="sells", **settings)
    trees.setRawPredictionCol("sells_raw").setProbabilityCol("sells_probability")
    if validation:
        trees.setValidationIndicatorCol(validation)
    assemble = VectorAssembler(inputCols=features, outputCol="class_features")
    return Pipeline(stages=[assemble, trees]).fit(train)


def fit_each(names: Iterable[str], fit: Callable[[str], object], threads: int = THREADS) -> dict:
    """Fit several models at once; each fit is its own chain of Spark jobs."""
    names = list(names)
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(names, pool.map(fit, names)))


def grid_search(rows: DataFrame, validation: str, features: list[str], grid: list[dict] = GRID,
                label: str = QTY, scale: bool = False,
                **settings) -> tuple[dict, int | None, list[tuple[dict, float | None]]]:
    """Settings with the smallest validation MAE, their number of trees, and all errors.

    ``validation`` names a boolean column; its rows stop the boosting of every trial.
    Without such rows nothing is tried: the first settings and no error are returned.
    """
    if rows.filter(validation).isEmpty():
        return grid[0], None, [(s, None) for s in grid]
    trials = []
    for setting in grid:
        model = fit_regressor(rows, features, label, scale, validation, **{**settings, **setting})
        error = (model.transform(rows.filter(validation))
                 .agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0])
        trials.append((setting, trees_of(model), error))
    best = min(trials, key=lambda t: t[2])
    return best[0], best[1], [(s, e) for s, _, e in trials]


def spread_settings(rates: tuple[float, ...] = (0.05, 0.1, 0.2), depths: tuple[int, ...] = (3, 5), leaves: tuple[int, ...] = (5, 20),
                    shares: tuple[float, ...] = (0.8, 1.0)) -> list[dict]:
    """Every combination of the parameters, 24 by default."""
    return [{"stepSize": r, "maxDepth": d, "minInstancesPerNode": m, "subsamplingRate": s}
            for r in rates for d in depths for m in leaves for s in shares]


def halving_search(rows: DataFrame, validation: str, features: list[str], settings: list[dict], budgets: tuple[int, ...] = (5, 15, 45),
                   keep: int = 3, label: str = QTY, **fixed) -> tuple[dict, list[tuple]]:
    """The best of many settings by successive halving, and all trials.

    All settings start with the first budget of trees; one in ``keep`` of them, those with the smallest
    validation MAE, goes on to the next budget, which is as much larger as they are fewer, so every round
    costs about the same. Ties go to the setting that comes first. Inputs are assembled once and stored
    in memory; rounds fit at once. ``validation`` names a boolean column; without such rows the first
    setting is returned and nothing is tried. A trial is (round, setting, trees allowed, error, survived).
    """
    if rows.filter(validation).isEmpty():
        return settings[0], []
    ready = placed(VectorAssembler(inputCols=features, outputCol="inputs").transform(rows).select("inputs", label, validation))
    held_out = ready.filter(validation)

    def error(item: tuple[int, int]) -> float:
        place, trees = item
        model = GBTRegressor(featuresCol="inputs", labelCol=label, predictionCol="prediction", maxIter=trees,
                             validationIndicatorCol=validation, **{**fixed, **settings[place]}).fit(ready)
        return model.transform(held_out).agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0]

    alive, trials = list(range(len(settings))), []
    try:
        for i, trees in enumerate(budgets):
            errors = fit_each([(place, trees) for place in alive], error)
            order = sorted(alive, key=lambda place: (errors[place, trees], place))
            alive = order[:1 if i == len(budgets) - 1 else max(1, -(-len(order) // keep))]
            trials += [(i, str(settings[p]), trees, errors[p, trees], p in alive) for p in order]
    finally:
        ready.unpersist()
    return settings[alive[0]], trials


@dataclass
class ModelSet:
    """Fitted models by category with the features they expect."""

    features: list[str]
    models: dict[str, PipelineModel] = field(default_factory=dict)

    def save(self, folder: str) -> None:
        for category, model in self.models.items():
            model.write().overwrite().save(f"{folder}/{category}")

    @staticmethod
    def load(folder: str, features: list[str], categories: list[str]) -> ModelSet:
        return ModelSet(features, {c: PipelineModel.load(f"{folder}/{c}") for c in categories})

    def registry(self, spark: SparkSession) -> DataFrame:
        """One row per fitted model, bounded by the models the driver holds."""
        return spark.createDataFrame([(c,) for c in sorted(self.models)], f"{CATEGORY} string")

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Score each category with its own model; rows without a model are left out."""
        aligned = encode.align_features(df, self.features, _distinct(keep, self.features))
        parts = [model.transform(aligned.filter(F.col(CATEGORY) == c))
                 .select(*keep, F.greatest("prediction", F.lit(0.0)).alias(PRED))
                 for c, model in self.models.items()]
        return reduce(DataFrame.unionByName, parts)

    def skipped(self, df: DataFrame) -> DataFrame:
        """Categories of ``df`` that have no model, with their rows."""
        known = F.broadcast(self.registry(df.sparkSession))
        return df.join(known, CATEGORY, "left_anti").groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("rows"))


def _distinct(keep: list[str], features: list[str]) -> list[str]:
    lowered = {f.lower() for f in features}
    return [c for c in keep if c.lower() not in lowered]


def train_per_category(train: DataFrame, features: list[str], settings: dict | Callable[[str], dict],
                       scale: bool = False, minimum: int = MIN_ROWS, validation: str | None = None) -> ModelSet:
    """One regressor per category with enough rows.

    ``train`` is best stored by category. ``validation`` names a boolean column whose rows
    stop the boosting early.
    """
    def fit(category: str) -> PipelineModel:
        chosen = settings(category) if callable(settings) else settings
        rows = placed(train.filter(F.col(CATEGORY) == category))
        try:
            return fit_regressor(rows, features, scale=scale, validation=validation, **chosen)
        finally:
            rows.unpersist()

    return ModelSet(features, fit_each(categories_with_enough(train, minimum), fit))


# ---- protocols -----------------------------------------------------------------------


@dataclass
class Hurdle:
    """Whether a day sells, and how much when it does."""

    classifier: PipelineModel
    regressor: PipelineModel | None

    def save(self, folder: str) -> None:
        self.classifier.write().overwrite().save(f"{folder}/classifier")
        if self.regressor is not None:
            self.regressor.write().overwrite().save(f"{folder}/regressor")

    @staticmethod
    def load(folder: str, sells: bool = True) -> Hurdle:
        """``sells`` is false for a hurdle that was saved without a regressor."""
        return Hurdle(PipelineModel.load(f"{folder}/classifier"),
                      PipelineModel.load(f"{folder}/regressor") if sells else None)

    def score(self, df: DataFrame) -> DataFrame:
        """``Predicted_Sales`` is 0 where the classifier says no sale."""
        flagged = self.classifier.transform(df)
        if self.regressor is None:
            return flagged.withColumn(PRED, F.lit(0.0))
        sized = self.regressor.transform(flagged)
        size = F.greatest(F.expm1("prediction"), F.lit(0.0))
        return sized.withColumn(PRED, F.when(F.col("sells") == 1, size).otherwise(0.0))


def fit_hurdle(train: DataFrame, features: list[str], validation: str | None = None,
               classifier: dict = HURDLE_CLASSIFIER, regressor: dict = BUS_SETTINGS,
               grid: list[dict] | None = None) -> Hurdle:
    """Classifier on all rows, regressor on log1p of the rows that sold.

    With ``validation`` its rows stop the boosting, and every setting of ``grid`` for the
    regressor is judged by the error of the whole hurdle on all of them, rows without
    sales included. A day type that always or never sells needs no classifier split;
    Spark handles it as a single-leaf tree.
    """
    labelled = placed(train.withColumn("sold", (F.col(QTY) > 0).cast("double"))
                      .withColumn("log_quantity", F.log1p(QTY)))
    try:
        first = fit_classifier(labelled, features, "sold", validation, **classifier)
        positive = labelled.filter("sold = 1")
        judged = validation and not labelled.filter(validation).isEmpty()
        if positive.isEmpty():
            return Hurdle(first, None)
        stop = validation if validation and not positive.filter(validation).isEmpty() else None
        fitted = [Hurdle(first, fit_regressor(positive, features, "log_quantity", validation=stop, **{**regressor, **g}))
                  for g in (grid if grid and judged else [{}])]
        if len(fitted) == 1:
            return fitted[0]

        def error(hurdle: Hurdle) -> float:
            return hurdle.score(labelled.filter(validation)).agg(F.avg(F.abs(F.col(QTY) - F.col(PRED)))).first()[0]

        return min(fitted, key=error)
    finally:
        labelled.unpersist()


def train_monthly(monthly_features: DataFrame, valid_from: str, grid: list[dict] = GRID,
                  features: list[str] = HYBRID_FEATURES, settings: dict = MONTHLY_SETTINGS,
                  minimum: int = MIN_ROWS) -> tuple[ModelSet, list[tuple]]:
    """Per category: grid with early stopping on the rows from ``valid_from`` on, then a refit
    of all rows with the settings and the number of trees of the best trial.

    Returns the refitted models and (category, setting, validation MAE) of all trials; a
    category without validation rows is fitted with the first settings and null errors.
    """
    rows = monthly_features.withColumn("_valid", F.col(DATE) >= F.lit(valid_from).cast("date"))

    def fit(category: str):
        mine = placed(rows.filter(F.col(CATEGORY) == category))
        try:
            best, trees, trials = grid_search(mine, "_valid", features, grid, scale=True, **settings)
            chosen = {**settings, **best, "maxIter": trees or min(100, settings["maxIter"])}
            return fit_regressor(mine, features, scale=True, **chosen), [(category, str(s), e) for s, e in trials]
        finally:
            mine.unpersist()

    fitted = fit_each(categories_with_enough(rows, minimum), fit)
    models = ModelSet(features, {c: m for c, (m, _) in fitted.items()})
    return models, [t for _, trials in fitted.values() for t in trials]


def specialised_settings(category: str) -> dict:
    """Absolute loss for buses, squared for the others."""
    return BUS_SETTINGS if category == "Bus" else THREE_WHEELER_SETTINGS


def incremental_update(old: PipelineModel, new_rows: DataFrame, features: list[str], stamp: str,
                       settings: dict = INCREMENTAL_SETTINGS
                       ) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit a second model on new rows and average it with the old one.

    80 % of the new rows train (hash of the key), the rest validates and stops the
    boosting. Returns the new model, scored validation rows (columns original, updated,
    ensemble) and one history row, whose ``n_estimators`` are the trees kept.
    """
    parted = stored(summary.hashed_split(new_rows, PANEL_KEY).withColumn("is_valid", F.col("part") == "test"), "parted")
    rows = placed(parted)
    try:
        new = fit_regressor(rows, features, validation="is_valid", **settings)
    finally:
        rows.unpersist()
    scored = old.transform(parted).withColumnRenamed("prediction", "original")
    scored = new.transform(scored.drop("raw_features", "features")) \
        .withColumnRenamed("prediction", "updated")
    scored = scored.select(*PANEL_KEY, QTY, "part", "original", "updated",
                           ((F.col("original") + F.col("updated")) / 2).alias("ensemble"))
    train, valid = F.col("part") == "train", F.col("part") == "test"

    def gap(column: str, rows) -> list:
        y, p = F.when(rows, F.col(QTY).cast("double")), F.when(rows, F.col(column))
        return [F.avg(F.abs(y - p)),
                1 - F.sum((y - p) * (y - p)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))]

    figures = {"train": ("updated", train), "val": ("updated", valid), "ensemble": ("ensemble", valid)}
    columns = [c.alias(f"{name}_{m}") for name, (col, rows) in figures.items()
               for c, m in zip(gap(col, rows), ("mae", "r2"))]
    history = scored.agg(F.lit(stamp).alias("timestamp"), F.count(F.lit(1)).alias("new_records"),
                         *columns, F.lit(float(settings["stepSize"])).alias("learning_rate"),
                         F.lit(trees_of(new)).alias("n_estimators"))
    return new, scored.filter(valid), history


# ---- monthly protocols of single categories ---------------------------------------------------


def direct_forecast(rows: DataFrame, models: ModelSet, first: str, months: int) -> DataFrame:
    """Months ahead at once: every lag is the last quantity, other history features stay at
    their last values. ``rows`` holds SPECIALISED_FEATURES."""
    frozen = [c for c in SPECIALISED_FEATURES if c.startswith("roll") or c in ("momentum", "state_avg", "state_encoded")]
    last = rows.groupBy(STATE, CATEGORY).agg(F.max_by(F.struct(QTY, *frozen), DATE).alias("r"))
    last = last.select(STATE, CATEGORY, F.col(f"r.{QTY}").alias("_last"), *[F.col(f"r.{c}").alias(c) for c in frozen])
    future = month_spine(last, first, months).select(
        "*", F.month(DATE).alias("month"), F.year(DATE).alias("year"), F.quarter(DATE).alias("quarter"),
        *[F.col("_last").alias(f"lag_month_{k}") for k in windows.MONTHLY_LAGS])
    return models.score(future, PANEL_KEY)


def back_score_days(days: DataFrame, rows: DataFrame, models: ModelSet) -> DataFrame:
    """History scored by monthly models: each day gets a thirtieth of its month's prediction."""
    by_month = models.score(rows, PANEL_KEY).withColumnRenamed(PRED, "Monthly_Pred")
    return allocate.thirtieth_onto_days(days, by_month).select(*PANEL_KEY, QTY, PRED)


def boosting_benchmark(national: DataFrame, test_rows: int = 12,
                       settings: dict = BENCHMARK_SETTINGS) -> tuple[ModelSet, DataFrame]:
    """A model per category on five features of the national months; the newest rows are the
    test. Returns the models and the scored test rows."""
    rows = last_rows_split(benchmark_features(national, [CATEGORY]), test_rows, [CATEGORY])
    rows = store_by_category(rows, "benchmark")
    fitted = train_per_category(rows.filter("NOT is_test"), BENCHMARK_FEATURES, settings, minimum=test_rows)
    return fitted, fitted.score(rows.filter("is_test"), [CATEGORY, DATE, QTY])


def compare_predictions(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Metrics of several prediction columns of the same rows, one row per column."""
    long = df.select(*keys, QTY, *columns).unpivot([*keys, QTY], columns, "model", PRED)
    return summary.metrics(long, [*keys, "model"])


def importance_table(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance, temporal) of a fitted tree model: one row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame(list(zip(features, map(float, weights))),
                                  "feature string, importance double")
    temporal = F.lower("feature").rlike("lag_|roll|ema_|ewma|seasonal_|trend_|volatility_")
    return table.withColumn("temporal", temporal)


def route_categories(df: DataFrame, families: dict[str, str], default: str = "daily") -> DataFrame:
    """Model family per row: the registry is a short literal map."""
    table = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    return df.withColumn("family", F.coalesce(F.try_element_at(table, F.col(CATEGORY)), F.lit(default)))


def with_state_codes(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    return encode.apply_codes(df, encode.code_table(df, STATE) if codes is None else codes, STATE)
