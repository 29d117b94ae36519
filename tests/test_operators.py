"""Cleaning, merging, positions, group figures, allocation and metrics."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saleloom.functions import rules, scores
from saleloom.operators import allocate, clean, encode, group_stats, merge, position, summary
from saleloom.schema import CATEGORY, DATE, PRED, QTY, STATE
from saleloom.sources import panel as panel_source
from saleloom.sources import sheets


def panel_rows(spark, rows):
    return spark.createDataFrame(rows, f"{DATE} string, {STATE} string, {CATEGORY} string, {QTY} long") \
        .withColumn(DATE, F.to_date(DATE))


# ---- rules and cleaning ------------------------------------------------------------


@pytest.mark.parametrize("name,category", [
    (" two wheeler(nt) ", "2-Wheelers"), ("M-CYCLE/SCOOTER", "2-Wheelers"), ("e-rickshaw(p)", "3-Wheelers"),
    ("E-RICKSHAW WITH CART (G)", "3-Wheelers"), ("LMV", "4-Wheelers"), ("JEEP TAXI", "4-Wheelers"),
    ("SCHOOL BUS", "Bus"), ("TRACTOR", "Others"), (None, "Others")])
def test_category_rules(spark, name, category):
    df = spark.createDataFrame([(name,)], "v string")
    assert df.select(rules.category_by_rules(F.col("v"))).first()[0] == category


def test_lookup_is_case_sensitive_and_trainer_knows_less(spark):
    df = spark.createDataFrame([("MOTOR CAR",), ("motor car",), ("LIGHT PASSENGER VEHICLE",), ("Bus",), (None,)], "v string")
    full = [r[0] for r in df.select(rules.category_by_lookup(F.col("v"))).collect()]
    assert full == ["4-Wheelers", "Others", "4-Wheelers", "Bus", "Others"]
    trainer = [r[0] for r in df.select(rules.category_by_lookup(F.col("v"), True)).collect()]
    assert trainer == ["4-Wheelers", "Others", "Others", "Bus", "Others"]


def test_header_rules(spark):
    df = spark.createDataFrame([("Data of Jammu & Kashmir (2024)",), ("no header",), (None,)], "h string")
    rows = df.select(rules.state_from_header(F.col("h")), rules.year_from_header(F.col("h"), 2025),
                     rules.state_key(rules.state_from_header(F.col("h")))).collect()
    assert [tuple(r) for r in rows] == [("Jammu & Kashmir", 2024, "JammuAndKashmir"), (None, 2025, None),
                                        (None, 2025, None)]


def test_missing_column_fails_before_any_job(spark):
    with pytest.raises(ValueError, match="EV_Sales_Quantity"):
        panel_source.standardise(spark.createDataFrame([("2020-01-01", "A")], "Date string, State string"))


def test_source_rows_are_coerced_and_summed(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "A", "Bus", "3"), ("2020-01-01", "A", "Bus", "x"), ("never", "A", "Bus", "9"),
         ("2020-01-01", "A", "Bus", "4.0")],
        "`Registration Date` string, State string, `Vehicle Category` string, Registrations string")
    assert [tuple(r)[1:] for r in panel_source.standardise(df).collect()] == [("A", "Bus", 7)]


def test_sheet_without_serial_rows_gives_nothing(spark):
    cells = spark.createDataFrame([("s", 0, "Data of X (2020)"), ("s", 1, "Total")], "sheet string, row_no int, c0 string")
    for i in range(1, 14):
        cells = cells.withColumn(f"c{i}", F.lit("5"))
    assert sheets.months_by_position(cells).count() == 0


def test_linear_gap(spark):
    df = panel_rows(spark, [("2020-01-01", "A", "Bus", 10), ("2020-01-05", "A", "Bus", 30)])
    assert [r["imputed"] for r in clean.impute_linear(df).orderBy(DATE).collect()] == [10, 15, 20, 25, 30]


# ---- merging -----------------------------------------------------------------------------


def test_upsert_keeps_last_of_new_source_and_unique_keys(spark):
    master = panel_rows(spark, [("2020-01-01", "A", "Bus", 1), ("2020-01-02", "A", "Bus", 2)])
    new = panel_rows(spark, [("2020-01-02", "A", "Bus", 5), ("2020-01-02", "A", "Bus", 7),
                             ("2020-01-03", "A", "Bus", 9)]).withColumn("n", F.col(QTY))
    out = merge.upsert_keep_last(master, new, ["n"]).orderBy(DATE).collect()
    assert [r[QTY] for r in out] == [1, 7, 9]
    again = merge.upsert_keep_last(merge.upsert_keep_last(master, new, ["n"]), new, ["n"])
    assert again.count() == 3
    plan = merge.upsert_keep_last(master, new, ["n"])._jdf.queryExecution().optimizedPlan()
    joined = plan.children().apply(0)  # the master's side of the union loses keys and nothing else
    assert "Aggregate" not in joined.children().apply(0).children().apply(0).toString()
    summed = merge.merge_sum(master, new).orderBy(DATE).collect()
    assert [r[QTY] for r in summed] == [1, 14, 9]


# ---- skew-safe building blocks -----------------------------------------------------------


def skewed(spark, n=20000):
    """One group holds half of all rows."""
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
                                 .alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"), "id")


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_group_figures_with_and_without_broadcast(spark, threshold):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, threshold)
    try:
        got = group_stats.attach_aggregates(skewed(spark), ["g"], [F.avg("v").alias("m")]).toPandas().sort_values("id")
    finally:
        spark.conf.unset(key)
    want = got.groupby("g")["v"].transform("mean")
    assert len(got) == 20000
    np.testing.assert_allclose(got["m"], want)


def test_positions_equal_a_plain_sort(spark):
    got = position.with_position(skewed(spark), ["v", "id"], "pos", ["g"]).toPandas()
    want = got.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (got.sort_values(["g", "v", "id"])["pos"] == want).all()
    whole = position.with_position(skewed(spark), ["id"], "pos").toPandas()
    assert (whole["pos"] == whole["id"] + 1).all()


def test_quantiles_equal_pandas(spark):
    df = skewed(spark)
    got = position.group_quantiles(df, ["g"], "v", [0.05, 0.5, 0.93]).toPandas().set_index("g").sort_index()
    pdf = df.toPandas().groupby("g")["v"]
    for i, p in enumerate((0.05, 0.5, 0.93)):
        np.testing.assert_allclose(got[f"q{i}"], pdf.quantile(p).sort_index())


def test_codes_are_sorted_and_unseen_is_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    test = spark.createDataFrame([("c",), ("z",), ("a",)], "s string")
    out = encode.apply_codes(test, encode.code_table(train, "s"), "s").collect()
    assert {r["s"]: r["s_code"] for r in out} == {"a": 0, "c": 2, "z": -1}


# ---- allocation ----------------------------------------------------------------------------


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 100000), min_size=1, max_size=12))
def test_allocation_adds_up(spark, totals):
    months = spark.createDataFrame(
        [(f"2001-{i + 1:02d}-01", "A", "Bus", t) for i, t in enumerate(totals)],
        f"{DATE} string, {STATE} string, {CATEGORY} string, {QTY} long").withColumn(DATE, F.to_date(DATE))
    pattern = spark.createDataFrame([("A", "Bus", 1, d, d / 496, 31) for d in range(1, 32)],
                                    f"{STATE} string, {CATEGORY} string, month int, day int, weight double, days int")
    out = allocate.allocate_exact(months, pattern).toPandas()
    by_month = out.groupby(pd.to_datetime(out[DATE]).dt.month)[QTY]
    assert by_month.sum().tolist() == [max(t, 0) for t in totals]
    assert (out[QTY] >= 0).all()
    assert by_month.count().tolist() == [[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][i] for i in range(len(totals))]


# ---- metrics --------------------------------------------------------------------------------


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([("one", 3.0, 1.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("off", 2.0, 3.0),
                                ("off", 2.0, 3.0), ("zero", 0.0, 1.0), ("zero", 4.0, 5.0)], "g string, y double, p double")
    rows = {r["g"]: r for r in df.groupBy("g").agg(*scores.score_columns(F.col("y"), F.col("p")),
                                                  scores.mape_all_rows(F.col("y"), F.col("p")).alias("all")).collect()}
    assert rows["one"]["r2"] is None and rows["flat"]["r2"] == 1 and rows["off"]["r2"] == 0
    assert rows["zero"]["mape"] == 25 and rows["zero"]["all"] is None


def test_rolling_origin_folds_equal_brute_force(spark):
    days = pd.date_range("2000-01-01", periods=330).date
    df = spark.createDataFrame(pd.DataFrame({DATE: days}))
    got = summary.rolling_origin(df, 180, 60, 30).toPandas()
    want = {(d, k) for k in range(4) for i, d in enumerate(days) if 180 + 30 * k <= i < 240 + 30 * k}
    assert set(zip(got[DATE], got["fold"])) == want


def test_histogram_counts_every_row(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    out = summary.histogram(df, "x", 10).toPandas()
    assert out["n"].sum() == 1001 and out["bin"].max() == 10


def test_full_compare_keeps_one_sided_keys(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], f"{CATEGORY} string, {QTY} long, {PRED} double")
    b = spark.createDataFrame([("y", 1, 1.0), ("y", 2, 3.0)], f"{CATEGORY} string, {QTY} long, {PRED} double")
    out = {r[CATEGORY]: r["mae_winner"] for r in summary.compare_runs(a, b).collect()}
    assert out == {"x": "a", "y": "b"}


def test_one_hot_vectors_take_any_number_of_values(spark):
    from pyspark.ml.functions import vector_to_array
    many = spark.range(1500).select(F.format_string("s%04d", "id").alias(STATE))
    table = encode.code_table(many, STATE)
    rows = spark.createDataFrame([("s0000",), ("s1499",), ("new",), (None,)], f"{STATE} string")
    out = encode.one_hot_vector(rows, table, STATE, "v", 1500).select(STATE, vector_to_array("v").alias("v")).collect()
    assert {r[STATE]: [i for i, x in enumerate(r["v"]) if x] for r in out} == {"s0000": [0], "s1499": [1499], "new": [], None: []}
    assert all(len(r["v"]) == 1500 for r in out)
