"""Placement of panels and the sales they are summed from, on rows of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleloom.catalog import inputs
from saleloom.operators import densify, windows
from saleloom.schema import CATEGORY, DATE, QTY, STATE, TABLES


@pytest.fixture
def wide(spark):
    """A session of many shuffle partitions, as large inputs have."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "64")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def small_panel(spark):
    return spark.createDataFrame(
        [(dt.date(2000, 1, 1), "A", "Bus", 3), (dt.date(2000, 1, 1), "A", "Bus", 4), (dt.date(2000, 1, 9), "B", "Others", 2),
         (dt.date(2000, 1, 5), None, "Bus", None)], f"{DATE} date, {STATE} string, {CATEGORY} string, {QTY} long")


def test_a_small_panel_takes_few_tasks_however_many_partitions_the_session_has(wide):
    dense = densify.dense_calendar(small_panel(wide))
    assert dense.rdd.getNumPartitions() == 1
    assert dense.count() == 3 * 5 * 9  # the null state has its days too
    assert dense.agg(F.sum(QTY)).first()[0] == 9
    features = windows.daily_features(dense.localCheckpoint(), windows.DailySpec(windows=(7,), lag_steps=(1,)))
    assert features.rdd.getNumPartitions() == 1


def test_placement_grows_with_the_rows_up_to_the_partitions_of_the_session(wide):
    df = small_panel(wide)
    parts = [densify.place_by_series(df, n).rdd.getNumPartitions()
             for n in (0, densify.ROWS_PER_TASK, densify.ROWS_PER_TASK + 1, 1000 * densify.ROWS_PER_TASK, None)]
    assert parts == [1, 1, 2, 64, 64]


def test_an_empty_panel_has_no_days(wide):
    assert densify.dense_calendar(small_panel(wide).limit(0)).isEmpty()


def test_panel_sums_repeats_untidy_classes_and_nulls(spark, tmp_path):
    day, key = dt.datetime(2000, 5, 1, 13), {"l_suppkey": 1}
    rows = {
        "nation": [{"n_nationkey": 1, "n_name": "A"}, {"n_nationkey": 2, "n_name": None}],
        "customer": [{"c_custkey": 1, "c_nationkey": 1}, {"c_custkey": 97, "c_nationkey": 1}, {"c_custkey": 3, "c_nationkey": 2},
                     {"c_custkey": None, "c_nationkey": 1}],
        "part": [{"p_partkey": 1, "p_type": "ECONOMY"}, {"p_partkey": 2, "p_type": "SMALL"}, {"p_partkey": 2, "p_type": "SMALL"},
                 {"p_partkey": 3, "p_type": None}, {"p_partkey": None, "p_type": "LARGE"}],
        "orders": [{"o_orderkey": 1, "o_custkey": 1, "o_orderdate": day}, {"o_orderkey": 2, "o_custkey": 97, "o_orderdate": day},
                   {"o_orderkey": 3, "o_custkey": 3, "o_orderdate": None}, {"o_orderkey": 89, "o_custkey": 1, "o_orderdate": day},
                   {"o_orderkey": 4, "o_custkey": None, "o_orderdate": day}],
        "lineitem": [{"l_orderkey": o, "l_partkey": p, "l_linenumber": n, "l_quantity": q, **key} for o, p, n, q in [
            (1, 1, 1, 5.9), (1, 1, 1, 5.9), (1, 2, 2, 1.0), (1, 3, 3, None), (2, 1, 1, 50.0), (3, 3, 1, 7.0), (89, 1, 1, 60.0),
            (4, 1, 1, 70.0), (1, None, 4, 80.0), (None, 1, 5, 90.0)]]}
    for name, found in rows.items():
        schema = spark.createDataFrame([], TABLES[name]).schema
        spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in found], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r[DATE], r[STATE], r[CATEGORY]): r[QTY] for r in inputs.panel(spark, str(tmp_path)).collect()}
    may = dt.date(2000, 5, 1)
    assert got == {(may, "A", "2-Wheelers"): 5 + 5 + 1 + 1, (may, "A", "Others"): None, (None, None, "Others"): 7}
