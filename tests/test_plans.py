"""Forecast loops, models and streaming jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from saleloom.catalog import QUERIES, inputs
from saleloom.operators import clean, encode, merge, windows
from saleloom.plans import baselines, models, ondemand, origins, recursive, scorers
from saleloom.schema import CATEGORY, DATE, PANEL_KEY, PRED, QTY, SERIES, STATE
from saleloom.session import cut_lineage, new_folder
from saleloom.streaming import jobs


QUICK = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "seed": 42}  # trees whose quality no test looks at


@pytest.fixture(scope="module")
def months(spark, dense):
    full = clean.between_dates(windows.monthly_totals(dense), before=inputs.LAST_FULL_DAY_BEFORE)
    return cut_lineage(full)


def test_loop_equals_fold_on_linear_predictor(spark, months):
    """A linear model rolled forward by the loop equals the recursion done by hand."""
    rows = months.select(*SERIES, DATE, QTY, *windows.lags([1, 2])).dropna()
    model = Pipeline(stages=[VectorAssembler(inputCols=["lag_1", "lag_2"], outputCol="x"),
                             LinearRegression(featuresCol="x", labelCol=QTY)]).fit(rows)
    state = merge.recent_values(months, 2)
    h = F.col("history")
    out = recursive.roll_forward(
        cut_lineage(state), {recursive.ALL: model}, recursive.months_after("2001-08-01", 5),
        lambda _: {"lag_1": recursive.back(h, 1), "lag_2": recursive.back(h, 2)},
        lambda v: {"history": windows.tail(F.array_append("history", v), 2)}, cut_every=2).toPandas()
    line = model.stages[-1]
    start = {(r[STATE], r[CATEGORY]): list(r["history"]) for r in state.collect()}
    for key, rows in out.sort_values(DATE).groupby(SERIES):
        past = start[key]
        for got in rows[PRED]:
            want = max(line.intercept + line.coefficients[0] * past[-1] + line.coefficients[1] * past[-2], 0.0)
            assert got == pytest.approx(want, abs=1e-6)
            past.append(want)


@pytest.mark.parametrize("scale", [True, False])
def test_fold_equals_loop_on_trees(spark, months, scale):
    """Trees walked inside one expression give what Spark's own models give date by date."""
    rows = cut_lineage(models.with_state_codes(windows.hybrid_monthly_features(months)))
    fitted = {c: models.fit_regressor(rows.filter(F.col(CATEGORY) == c), models.HYBRID_FEATURES, scale=scale, **QUICK) for c in ("Bus", "Others")}
    codes = encode.code_table(months, STATE)
    spans, length = windows.MONTHLY_SPANS, max(windows.MONTHLY_LAGS)
    state = cut_lineage(encode.apply_codes(recursive.series_state(months, length, spans), codes, STATE))
    dates = recursive.months_after("2001-08-01", 7)
    known = recursive.hybrid_history()
    loop = recursive.roll_forward(state, fitted, dates, lambda day: known | recursive.hybrid_calendar(day),
                                  lambda v: recursive.push_value(v, length, spans))
    fold = recursive.forecast_months(months, codes, fitted, "2001-08-01", 7)
    a, b = (x.toPandas().sort_values([*SERIES, DATE]).reset_index(drop=True) for x in (loop, fold))
    assert len(a) == len(b) == 7 * state.filter(F.col(CATEGORY).isin("Bus", "Others")).count()
    assert a[[*SERIES, DATE]].equals(b[[*SERIES, DATE]]) and a[PRED].nunique() > 10
    np.testing.assert_allclose(a[PRED], b[PRED], rtol=1e-9, atol=1e-9)


def test_trees_as_arrays():
    text = """GBTRegressionModel: uid=x, numTrees=3, numFeatures=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= -2.0E-3)
      Predict: 1.0
     Else (feature 1 > -2.0E-3)
      If (feature 0 <= 0.25)
       Predict: 2.0
      Else (feature 0 > 0.25)
       Predict: 3.0
    Else (feature 0 > 0.5)
     Predict: 4.0
  Tree 1 (weight 0.1):
    Predict: 7.0
  Tree 2 (weight 0.5):
    If (feature 1 <= 1.0)
     Predict: 5.0
    Else (feature 1 > 1.0)
     Predict: 6.0
"""
    arrays = scorers.trees_of_text(text)
    assert arrays["roots"] == [0, 7, 8] and arrays["weights"] == [1.0, 0.1, 0.5] and arrays["depth"] == 3

    def walk(x, node):
        while arrays["feature"][node] >= 0:
            node = arrays["left" if x[arrays["feature"][node]] <= arrays["threshold"][node] else "right"][node]
        return arrays["threshold"][node]

    assert [walk(x, 0) for x in ([0, -1], [0.1, 0], [0.3, 0], [9, 0])] == [1, 2, 3, 4]
    assert [walk([0, y], 8) for y in (1, 1.5)] == [5, 6]
    with pytest.raises(ValueError):
        scorers.trees_of_text("head\n Tree 0 (weight 1.0):\n  If (feature 0 in {1.0})")


def test_loop_over_many_states(spark):
    """Names travel as codes and weights by code: no column and no literal for each of 3,000 states."""
    n = 3000
    rows = spark.range(n * 70).select(
        F.date_add(F.lit("2001-01-01"), (F.col("id") % 70).cast("int")).alias(DATE), F.format_string("S%05d", F.floor(F.col("id") / 70)).alias(STATE),
        F.lit("Bus").alias(CATEGORY), (F.floor(F.col("id") / 70) % 10 + F.col("id") % 2).alias(QTY))
    panel = cut_lineage(rows)

    def fit(train, names, codes):
        line = LinearRegression(featuresCol="x", labelCol=QTY, solver="l-bfgs", maxIter=3)
        return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), line]).fit(train)

    out = recursive.forecast_all_series(panel, fit, "2001-03-12", 3)
    assert len(out.columns) == 4 and out.count() == 3 * n
    by_level = out.groupBy((F.substring(STATE, 6, 1)).alias("k")).agg(F.avg(PRED).alias("m")).orderBy("k").collect()
    assert by_level[0]["m"] < by_level[9]["m"]


def test_step_features_equal_window_features(spark, months):
    """The state of a series gives the features the windows give for the next month."""
    last = F.lit("2001-07-01").cast("date")
    known = recursive.hybrid_history() | recursive.hybrid_calendar(recursive.months_after("2001-07-01", 1)[0])
    state = recursive.series_state(months.filter(F.col(DATE) < last), 12, windows.MONTHLY_SPANS)
    names = [f for f in models.HYBRID_FEATURES if f != "State_code"]
    got = state.select(*SERIES, *[known[n].cast("double").alias(n) for n in names]).toPandas()
    want = windows.hybrid_monthly_features(months).filter(F.col(DATE) == last).select(
        *SERIES, *[F.col(n).cast("double") for n in names]).toPandas()
    a, b = (d.sort_values(SERIES).reset_index(drop=True) for d in (got, want))
    np.testing.assert_allclose(a[names], b[names], rtol=1e-8, atol=1e-9)


def test_daily_step_features_equal_window_features(spark, dense):
    spec = windows.DailySpec(mode="shifted", windows=(7, 30), means_until=inputs.LAST_FULL_DAY_BEFORE)
    day = F.lit("2001-07-31").cast("date")
    known = recursive.daily_history(spec) | recursive.calendar_values(recursive.days_after("2001-07-31", 1)[0])
    state = recursive.series_state(dense.filter(F.col(DATE) < day), 90, list(spec.windows))
    names = [n for n in recursive.daily_columns(spec) if "mean" not in n.split("_") or n.startswith("rolling")]
    names = [n for n in names if n in known]
    got = state.select(*SERIES, *[known[n].cast("double").alias(n) for n in names]).toPandas()
    want = windows.daily_features(dense, spec).filter(F.col(DATE) == day).select(
        *SERIES, *[F.col(n).cast("double") for n in names]).toPandas()
    a, b = (d.sort_values(SERIES).reset_index(drop=True) for d in (got, want))
    np.testing.assert_allclose(a[names], b[names].fillna(0), rtol=1e-8, atol=1e-9)


def test_ar_coefficients_equal_least_squares(spark, months):
    got = {(r[STATE], r[CATEGORY]): r["coefficients"] for r in baselines.ar_coefficients(months, 3).collect()}
    pdf = months.toPandas().sort_values(DATE)
    for key, rows in list(pdf.groupby(SERIES))[:10]:
        d = rows[QTY].diff().dropna().to_numpy(dtype=float)
        x = np.column_stack([d[2:-1], d[1:-2], d[:-3]])
        np.testing.assert_allclose(got[key], np.linalg.lstsq(x, d[3:], rcond=None)[0], rtol=1e-6, atol=1e-8)


def test_ar_forecast_follows_its_equation(spark, months):
    out = baselines.ar_forecast(months, 2, order=1).toPandas()
    c = {(r[STATE], r[CATEGORY]): r["coefficients"][0] for r in baselines.ar_coefficients(months, 1).collect()}
    pdf = months.toPandas().sort_values(DATE)
    for key, rows in list(pdf.groupby(SERIES))[:5]:
        a, b = rows[QTY].iloc[-2:]
        got = out[(out[STATE] == key[0]) & (out[CATEGORY] == key[1])].sort_values(DATE)["forecast"].tolist()
        first = b + c[key] * (b - a)
        assert got == pytest.approx([first, first + c[key] * (first - b)])


def test_monthly_models_score_every_row_without_negatives(spark, months):
    rows = cut_lineage(models.with_state_codes(windows.hybrid_monthly_features(months)))
    fitted = models.train_per_category(clean.between_dates(rows, before=inputs.TEST_FROM),
                                       models.HYBRID_FEATURES, QUICK, scale=True)
    scored = fitted.score(clean.between_dates(rows, start=inputs.TEST_FROM), [*PANEL_KEY, QTY])
    assert scored.filter(F.col(PRED) < 0).count() == 0
    assert scored.count() == 7 * 125
    assert set(fitted.models) == {"2-Wheelers", "3-Wheelers", "4-Wheelers", "Bus", "Others"}


def test_hurdle_says_zero_where_it_expects_no_sale(spark, dense):
    rows = models.with_state_codes(models.hurdle_features(dense.filter(F.col(CATEGORY) == "Bus")))
    small = {"maxIter": 2, "maxDepth": 3, "seed": 42}
    fitted = models.fit_hurdle(clean.between_dates(rows, before="1997-01-01"), models.HURDLE_FEATURES,
                               classifier=small, regressor=small)
    scored = fitted.score(clean.between_dates(rows, "1997-01-01", "1997-03-01"))
    assert scored.filter("sells = 0 AND Predicted_Sales <> 0").count() == 0
    assert scored.filter(F.col(PRED) < 0).count() == 0


def test_too_little_data_means_no_model(spark, months):
    few = months.filter(F.col(CATEGORY).isin("Bus", "Others")).filter(
        (F.col(CATEGORY) == "Bus") | (F.col(STATE) == "NATION_1") & (F.col("Year") == 2000))
    assert models.categories_with_enough(few) == ["Bus"]


def test_on_demand_step_inputs_equal_training_inputs(spark, dense):
    """What the loop sees on a day is what training saw: every column, for series that sold on 90 days or were never short."""
    day = F.lit("2001-07-31").cast("date")
    past = dense.filter(F.col(DATE) < day)
    want = ondemand.training_rows(dense).filter(F.col(DATE) == day)
    names = [c for c in ondemand.model_columns() if c not in recursive.calendar_values(recursive.days_after("2001-07-31", 1)[0])
             and "overall" not in c and "ratio" not in c and "interaction" not in c]
    state = ondemand._with_groups(recursive.series_state(past, 90, ondemand.WIDTHS), dense, None)
    h = F.col("history")
    known = ({f"lag_{k}": recursive.back(h, k) for k in ondemand.LAGS} | ondemand._from_history(h)
             | {f"ema_{n}": F.col(f"sum_{n}") / F.col(f"weight_{n}") for n in ondemand.WIDTHS})
    known |= dict(zip([f"rolling_{s}_{n}" for s, ns in ondemand.FIGURES.items() for n in ns], recursive.tail_figures(h, ondemand.FIGURES)))
    got = state.select(*SERIES, *[known.get(n, F.col(n)).cast("double").alias(n) for n in names if n in known or n == "State_code"]).toPandas()
    want = want.select(*SERIES, *[F.col(c).cast("double") for c in got.columns if c not in SERIES]).toPandas()
    a, b = (d.sort_values(SERIES).reset_index(drop=True) for d in (got, want))
    assert len(a.columns) > 30
    np.testing.assert_allclose(a.drop(columns=SERIES), b[a.columns].drop(columns=SERIES), rtol=1e-8, atol=1e-9)


def test_model_tells_states_apart(spark, dense):
    rows = ondemand.training_rows(dense.filter("Vehicle_Category = '2-Wheelers' AND State IN ('NATION_7', 'NATION_3')"))
    assert {r["State_code"] for r in rows.select("State_code").distinct().collect()} == {0, 1}


def test_on_demand_sources_and_smoke_cases(spark, dense):
    """The two smoke cases: a model category for 30 days, a run-rate category for 90."""
    rows = clean.between_dates(ondemand.training_rows(dense), start="2001-01-01")
    fitted = models.train_per_category(rows.filter(F.col(CATEGORY) == "2-Wheelers"), ondemand.model_columns(),
                                       {**QUICK, "maxIter": 3})
    asked = spark.createDataFrame([("NATION_7", "2-Wheelers"), ("NATION_7", "Others"), ("NATION_2", "Bus")],
                                  f"{STATE} string, {CATEGORY} string")
    out = ondemand.on_demand(dense, asked, fitted.models, "2001-08-02", 8, 2000).toPandas()
    assert len(out) == 3 * 8 and (out["Forecasted_Sales"] >= 0).all()
    by = {c: set(s) for c, s in out.groupby(CATEGORY)["source"]}
    assert by["Bus"] == {"run rate"} and by["Others"] == {"projection"}
    assert by["2-Wheelers"] <= {"model", "projection"}


def test_incremental_update_averages(spark, sf_dir):
    rows = models.hurdle_features(inputs.dense(spark, sf_dir).filter("Vehicle_Category = 'Bus'"))
    names = [f for f in models.HURDLE_FEATURES if f != "State_code"]
    old = models.fit_regressor(clean.between_dates(rows, "1999-01-01", "1999-03-01"), names, **QUICK)
    new, scored, history = models.incremental_update(old, clean.between_dates(rows, start="2001-06-01"), names, "now",
                                                     {**QUICK, "maxIter": 30})
    assert scored.filter("abs(ensemble - (original + updated) / 2) > 1e-9").isEmpty()
    row = history.first()
    assert row["n_estimators"] == models.trees_of(new) and 0 < scored.count() < row["new_records"]
    assert row["ensemble_mae"] <= max(row["val_mae"], scored.agg(F.avg(F.abs(F.col(QTY) - F.col("original")))).first()[0]) + 1e-9


def test_hurdle_survives_saving(spark, dense):
    rows = models.hurdle_features(dense.filter("Vehicle_Category = 'Bus' AND State = 'NATION_1'"))
    names = [f for f in models.HURDLE_FEATURES if f != "State_code"]
    train = clean.between_dates(rows, before="1997-01-01").withColumn("v", F.col(DATE) >= F.lit("1996-10-01").cast("date"))
    fitted = models.fit_hurdle(train, names, "v", {"maxIter": 2, "seed": 1}, {**QUICK, "maxIter": 3}, [{"maxDepth": 2}, {"maxDepth": 4}])
    folder = new_folder(spark, "test-hurdle")
    fitted.save(folder)
    a = fitted.score(rows).select(DATE, PRED).collect()
    assert a == models.Hurdle.load(folder).score(rows).select(DATE, PRED).collect()


def test_grid_without_validation_rows_is_not_tried(spark, months):
    rows = windows.hybrid_monthly_features(months).withColumn("v", F.lit(False))
    best, trees, trials = models.grid_search(rows, "v", ["Lag_1"], [{"maxDepth": 2}, {"maxDepth": 3}])
    assert best == {"maxDepth": 2} and trees is None and [e for _, e in trials] == [None, None]


# ---- streaming ------------------------------------------------------------------------------


def test_stream_resumes_and_reads_each_file_once(spark):
    work = new_folder(spark, "test-resume")
    schema = "Date date, State string, Vehicle_Category string, EV_Sales_Quantity long, n long"
    def push(rows):
        spark.createDataFrame(rows, schema.replace("Date date", "Date string")).withColumn(DATE, F.to_date(DATE)) \
            .coalesce(1).write.mode("append").parquet(f"{work}/in")
    push([("2020-01-01", "A", "Bus", 1, 1)])
    start = spark.createDataFrame([], schema).select(*PANEL_KEY, QTY)
    jobs.write_panel(start, f"{work}/panel")
    stream_schema = spark.read.parquet(f"{work}/in").schema
    def run():
        stream = jobs.file_stream(spark, f"{work}/in", stream_schema)
        return jobs.upsert_months(spark, stream, f"{work}/panel", f"{work}/checkpoint", ["n"]).collect()
    assert [r[QTY] for r in run()] == [1]
    assert [r[QTY] for r in run()] == [1]
    push([("2020-01-01", "A", "Bus", 5, 2), ("2020-01-02", "A", "Bus", 8, 1)])
    assert sorted(r[QTY] for r in run()) == [5, 8]


def test_upsert_leaves_other_months_alone(spark):
    work = new_folder(spark, "test-months")
    rows = [("2020-01-05", "A", "Bus", 1), ("2020-02-05", "A", "Bus", 2), ("2020-03-05", "A", "Bus", 3)]
    start = spark.createDataFrame(rows, "Date string, State string, Vehicle_Category string, EV_Sales_Quantity long").withColumn(DATE, F.to_date(DATE))
    jobs.write_panel(start, f"{work}/panel")
    before = set(jobs.panel_as_of(spark, f"{work}/panel").inputFiles())
    start.filter("EV_Sales_Quantity = 2").withColumn(QTY, F.lit(7).cast("long")).write.parquet(f"{work}/in")
    stream = jobs.file_stream(spark, f"{work}/in", start.schema)
    after = jobs.upsert_months(spark, stream, f"{work}/panel", f"{work}/checkpoint", [QTY])
    assert sorted(r[QTY] for r in after.collect()) == [1, 3, 7]
    assert len(before & set(after.inputFiles())) == 2
    assert sorted(r[QTY] for r in jobs.panel_as_of(spark, f"{work}/panel", -1).collect()) == [1, 2, 3]


def shuffled_feed(spark, sf_dir, work, repeats):
    """The feed in six files whose rows are in no order of time, a third of it twice."""
    feed = inputs.live_feed(spark, sf_dir)
    if repeats:
        feed = feed.unionByName(feed.filter("id % 3 = 0"))
    feed.repartition(6, F.xxhash64("id", F.rand(3))).write.parquet(f"{work}/in")
    return jobs.file_stream(spark, f"{work}/in", spark.read.parquet(f"{work}/in").schema, files_per_batch=1)


def test_live_windows_take_late_rows(spark, sf_dir):
    work = new_folder(spark, "test-windows")
    stream = shuffled_feed(spark, sf_dir, work, False)
    got = jobs.live_windows(stream, f"{work}/out", f"{work}/checkpoint").toPandas()
    feed = inputs.live_feed(spark, sf_dir)
    want = (feed.groupBy(F.window("timestamp", "5 minutes").alias("w"), "vehicle_category")
            .agg(F.count("*").alias("events"), F.avg("error").alias("mae"), F.avg("actual").alias("mean_actual"))
            .select(F.col("w.start").alias("window_start"), "vehicle_category", "events", "mae", "mean_actual").toPandas())
    keys = ["window_start", "vehicle_category"]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True)[want.columns],
                                  want.sort_values(keys).reset_index(drop=True))


def test_repeats_go_whatever_their_age(spark, sf_dir):
    work = new_folder(spark, "test-repeats")
    stream = shuffled_feed(spark, sf_dir, work, True)
    got = jobs.without_repeats(stream, "id", f"{work}/out", f"{work}/checkpoint")
    want = inputs.live_feed(spark, sf_dir)
    assert got.count() == want.count()
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_repeats_after_a_batch_without_rows(spark):
    work = new_folder(spark, "test-repeats")
    rows = spark.createDataFrame([(k, f"2024-01-0{k + 1} 10:00:00", k * 1.5) for k in range(4)], "id long, t string, actual double")
    rows = rows.select("id", F.col("t").cast("timestamp").alias("timestamp"), "actual").coalesce(1)
    for part in (rows.limit(0), rows, rows.filter("id > 1")):  # each of them is a batch of its own, the first without rows
        part.write.mode("append").parquet(f"{work}/in")
        stream = jobs.file_stream(spark, f"{work}/in", rows.schema, files_per_batch=1)
        got = jobs.without_repeats(stream, "id", f"{work}/out", f"{work}/checkpoint")
    assert got.columns == rows.columns
    assert sorted(got.collect()) == sorted(rows.collect())


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from saleloom import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake())


def test_folds_fit_their_own_rows(spark):
    """Fits of running totals equal least squares on each fold's rows, gaps, nulls and useless inputs included."""
    rng = np.random.default_rng(6)
    frames = []
    for state, n in (("A", 160), ("B", 90), ("C", 12)):
        x1, x2 = rng.integers(0, 20, n), rng.integers(0, 9, n)
        frames.append(pd.DataFrame({DATE: pd.date_range("2001-01-01", periods=n).date, STATE: state, CATEGORY: "Bus", "x1": x1, "x2": x2,
                                    "x3": 2 * x1 + 3, QTY: 3 * x1 - x2 + rng.integers(0, 4, n)}))
    pdf = pd.concat(frames, ignore_index=True)
    pdf = pdf.drop(index=pdf.index[(pdf[STATE] == "B") & (pdf.index % 5 == 0)])
    pdf.loc[pdf.index[::17], "x2"] = np.nan
    pdf["x2"] = pdf["x2"].astype("Int64")
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), f"{DATE} date, {STATE} string, {CATEGORY} string, x1 long, x2 long, x3 long, {QTY} long")
    for inputs_, same in ((["x1", "x2"], ["x1", "x2"]), (["x1", "x3", "x2"], ["x1", "x2"])):
        got = {(r[STATE], r["fold"]): r for r in origins.fold_fits(df, inputs_, 40, 20, 10).collect()}
        day = (pd.to_datetime(pdf[DATE]) - pd.Timestamp("2001-01-01")).dt.days
        seen = 0
        for fold in range((159 - 40 - 20 + 1) // 10 + 1):
            for state in "ABC":
                rows = pdf[(pdf[STATE] == state) & (day >= 10 * fold) & (day < 10 * fold + 40)].dropna()
                if rows.empty:
                    assert (state, fold) not in got
                    continue
                r = got[state, fold]
                x = np.column_stack([np.ones(len(rows)), *[rows[c].astype(float) for c in same]])
                if len(rows) > 5:
                    want = np.linalg.lstsq(x, rows[QTY].astype(float), rcond=None)[0]
                    np.testing.assert_allclose([r["intercept"], r["weight_x1"], r["weight_x2"]], want, rtol=1e-7, atol=1e-7)
                    assert r["n"] == len(rows) and (len(inputs_) == 2 or r["weight_x3"] == 0)
                    seen += 1
        assert seen > 15
    scored = origins.refit_each_fold(df, ["x1"], 40, 20, 10)
    assert scored.columns == [*df.columns, "fold", PRED] and scored.filter(F.col(PRED).isNotNull()).count() > 100


def test_halving_keeps_the_best(spark, months):
    rows = windows.hybrid_monthly_features(months).filter(F.col(CATEGORY) == "Bus").withColumn("v", F.col(DATE) >= F.lit("2001-01-01").cast("date"))
    settings = models.spread_settings((0.1, 0.3), (2,), (5, 400), (1.0,))
    best, trials = models.halving_search(rows, "v", ["Lag_1", "Lag_12", "Month"], settings, (2, 4), 2, seed=1)
    assert [t[0] for t in trials] == [0] * 4 + [1] * 2 and {t[2] for t in trials if t[0] == 1} == {4}
    for i, going_on in ((0, 2), (1, 1)):
        ranked = [t for t in trials if t[0] == i]
        assert [t[3] for t in ranked] == sorted(t[3] for t in ranked) and [t[4] for t in ranked] == [True] * going_on + [False] * (len(ranked) - going_on)
    assert {t[1] for t in trials if t[0] == 1} == {t[1] for t in trials if t[0] == 0 and t[4]}
    assert str(best) == next(t[1] for t in trials if t[0] == 1 and t[4])
    assert models.halving_search(rows.withColumn("v", F.lit(False)), "v", ["Lag_1"], settings) == (settings[0], [])
