"""Window features against pandas, and the leak rule of the shifted mode."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saleloom.operators import windows
from saleloom.schema import CATEGORY, DATE, QTY, STATE


@pytest.fixture(scope="module")
def frame():
    """Three series; the longest spans several EWMA blocks."""
    rng = np.random.default_rng(7)
    parts = []
    for state, n in (("A", 700), ("B", 40), ("C", 1)):
        parts.append(pd.DataFrame({
            DATE: pd.date_range("2000-01-01", periods=n).date, STATE: state, CATEGORY: "Bus",
            QTY: rng.integers(0, 50, n)}))
    return pd.concat(parts, ignore_index=True)


def by_key(df):
    return df.sort_values([STATE, DATE]).reset_index(drop=True)


def grouped(frame):
    return by_key(frame).groupby([STATE, CATEGORY])[QTY]


def test_ewma_equals_pandas(spark, frame):
    spans = [3, 7, 90]
    out = by_key(windows.ewma(spark.createDataFrame(frame), spans).toPandas())
    for n in spans:
        want = grouped(frame).ewm(span=n).mean().reset_index(drop=True)
        np.testing.assert_allclose(out[f"ema_{n}"], want, rtol=1e-10)


def test_ewma_of_long_series_and_short_spans(spark):
    rng = np.random.default_rng(8)
    long = pd.DataFrame({DATE: pd.date_range("1990-01-01", periods=5000).date, STATE: "A", CATEGORY: "Bus",
                         QTY: rng.integers(0, 50, 5000)})
    out = by_key(windows.ewma(spark.createDataFrame(long), [1, 2, 3, 90, 2000]).toPandas())
    for n in (1, 2, 3, 90, 2000):
        np.testing.assert_allclose(out[f"ema_{n}"], long[QTY].ewm(span=n).mean(), rtol=1e-9)


def test_shifted_ewma_equals_pandas(spark, frame):
    out = by_key(windows.shifted_ewma(spark.createDataFrame(frame), [3]).toPandas())
    want = grouped(frame).transform(lambda x: x.shift(1).ewm(span=3).mean())
    np.testing.assert_allclose(out["EWMA_3"].astype(float), want, rtol=1e-10)


@pytest.mark.parametrize("mode", ["inclusive", "shifted"])
def test_rolling_equals_pandas(spark, frame, mode):
    df = spark.createDataFrame(frame)
    stats = ["mean", "std", "min", "max"]
    out = windows.rolling_medians(df.select("*", *windows.rolling([7, 30], stats, mode)), [7, 30], mode=mode)
    out = by_key(out.toPandas())
    for n in (7, 30):
        for stat in [*stats, "median"]:
            shift = 0 if mode == "inclusive" else 1
            want = grouped(frame).transform(
                lambda x: getattr(x.shift(shift).rolling(n, min_periods=1), stat)())
            np.testing.assert_allclose(out[f"rolling_{stat}_{n}"].astype(float), want, rtol=1e-9)


def test_trend_stays_inside_series(spark, frame):
    df = spark.createDataFrame(frame).select("*", *windows.rolling([7], ["mean"], "inclusive"))
    out = by_key(df.select("*", windows.first_difference("rolling_mean_7", "trend_7")).toPandas())
    want = grouped(frame).transform(lambda x: x.rolling(7, min_periods=1).mean().diff().fillna(0))
    np.testing.assert_allclose(out["trend_7"], want, atol=1e-9)


def test_shifted_features_ignore_own_quantity(spark, frame):
    """Changing one day's target leaves that day's shifted features alone."""
    spec = windows.DailySpec(mode="shifted", windows=(7, 30), means_until="2000-02-01")
    day = F.lit("2000-02-20").cast("date")
    df = spark.createDataFrame(frame)
    changed = df.withColumn(QTY, F.when(F.col(DATE) == day, F.col(QTY) + 1000).otherwise(F.col(QTY)))
    rows = [windows.daily_features(d, spec).filter(F.col(DATE) == day).filter(F.col(STATE) == "A")
            .drop(QTY).toPandas() for d in (df, changed)]
    pd.testing.assert_frame_equal(*rows)
    monthly = [windows.hybrid_monthly_features(windows.monthly_totals(d))
               .filter(F.col(DATE) == F.lit("2000-02-01").cast("date")).drop(QTY)
               .orderBy(STATE).toPandas() for d in (df, changed)]
    pd.testing.assert_frame_equal(*monthly)


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        windows.frame(None, 3, "centered")
