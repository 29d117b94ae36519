"""Category codes, one-hot columns, target means and scaling, all as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleloom.operators.group_stats import lookup_or_default
from saleloom.operators.position import group_quantiles, with_position
from saleloom.schema import QTY, STATE

UNSEEN = -1


def code_table(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Distinct values in sorted order with codes 0, 1, 2, ..."""
    code = code or f"{column}_code"
    values = df.select(column).dropna().distinct()
    return with_position(values, [column], code).withColumn(code, F.col(code) - 1)


def apply_codes(df: DataFrame, table: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Codes of a stored table; values it does not hold get -1."""
    return lookup_or_default(df, table, [column], code or f"{column}_code",
                             F.lit(UNSEEN).cast("long"))


def known_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values, for one column each; ``one_hot_vector`` serves columns with many values."""
    return sorted(r[0] for r in df.select(column).dropna().distinct().collect())


def one_hot(column: str, values: list[str], prefix: str) -> list[Column]:
    return [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in values]


def one_hot_vector(df: DataFrame, table: DataFrame, column: str, name: str, size: int) -> DataFrame:
    """One sparse vector per row from a stored table of ``size`` codes, however many those are.

    Values that the table does not hold have no 1 in their vector.
    """
    coded = apply_codes(df, table.withColumnRenamed(f"{column}_code", "_code"), column, "_code").withColumn(
        "_code", F.when(F.col("_code") == UNSEEN, size).otherwise(F.col("_code")).cast("double"))
    largest = df.sparkSession.range(1).select(F.lit(float(size)).alias("_code"))  # tells the encoder the size
    return OneHotEncoder(inputCol="_code", outputCol=name).fit(largest).transform(coded).drop("_code")


def target_means(train: DataFrame, keys: list[str], name: str = "state_encoded") -> DataFrame:
    return train.groupBy(*keys).agg(F.avg(QTY).alias(name))


def target_encode(df: DataFrame, train: DataFrame, keys: list[str],
                  name: str = "state_encoded") -> DataFrame:
    """Training mean of the key; keys unseen in training get the overall mean."""
    overall = train.agg(F.avg(QTY)).scalar()
    return lookup_or_default(df, target_means(train, keys, name), keys, name, overall)


def _stacked(df: DataFrame, columns: list[str], fit) -> DataFrame:
    """One aggregate pass over all columns, then one parameter row per column."""
    stats = df.agg(*[fit(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).alias("p"))
            for i, c in enumerate(columns)]
    return stats.select(F.inline(F.array(*rows))).select("pos", "feature", "p.*")


def zscore_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, feature, mean, std): population deviation plus 1e-6."""
    return _stacked(df, columns, lambda c: F.struct(
        F.avg(c).alias("mean"), (F.stddev_pop(c) + F.lit(1e-6)).alias("std")))


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, feature, center, scale): exact median and interquartile range (1 where 0)."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value")
    q = group_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75])
    width = F.col("q2") - F.col("q0")
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")) - 1
    return q.select(order.cast("int").alias("pos"), "feature", F.col("q1").alias("center"),
                    F.when(width == 0, 1.0).otherwise(width).alias("scale"))


def minmax_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    return _stacked(df, columns, lambda c: F.struct(
        F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")))


def _with_parameters(df: DataFrame, params: DataFrame) -> DataFrame:
    """``df`` with all parameters as one map, from a single scalar subquery."""
    fields = [c for c in params.columns if c not in ("pos", "feature")]
    table = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*fields)))).alias("p"))
    return df.withColumn("_parameters", table.scalar())


def _parameter(feature: str, name: str) -> Column:
    return F.try_element_at("_parameters", F.lit(feature)).getField(name)


def apply_zscore(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    return _with_parameters(df, params).withColumns({
        c: (F.col(c) - _parameter(c, "mean")) / _parameter(c, "std") for c in columns}).drop("_parameters")


def undo_zscore(df: DataFrame, params: DataFrame, column: str, feature: str) -> DataFrame:
    """Scaled predictions back to units."""
    return _with_parameters(df, params).withColumn(
        column, F.col(column) * _parameter(feature, "std") + _parameter(feature, "mean")).drop("_parameters")


def apply_robust(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    return _with_parameters(df, params).withColumns({
        c: (F.col(c) - _parameter(c, "center")) / _parameter(c, "scale") for c in columns}).drop("_parameters")


def apply_minmax(df: DataFrame, params: DataFrame, columns: list[str],
                 low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scale to [low, high]; a constant column becomes ``low``."""
    def scaled(c: str) -> Column:
        a, b = _parameter(c, "low"), _parameter(c, "high")
        share = F.coalesce((F.col(c) - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0))
        return share * F.lit(high - low) + F.lit(low)
    return _with_parameters(df, params).withColumns({c: scaled(c) for c in columns}).drop("_parameters")


def undo_minmax(df: DataFrame, params: DataFrame, columns: list[str],
                low: float = 0.0, high: float = 1.0) -> DataFrame:
    def restored(c: str) -> Column:
        a, b = _parameter(c, "low"), _parameter(c, "high")
        return (F.col(c) - F.lit(low)) / F.lit(high - low) * (b - a) + a
    return _with_parameters(df, params).withColumns({c: restored(c) for c in columns}).drop("_parameters")


def align_features(df: DataFrame, expected: list[str], keep: list[str]) -> DataFrame:
    """Exactly the expected features in order: missing ones are 0, others go."""
    features = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
                else F.lit(0.0).alias(c) for c in expected]
    return df.select(*keep, *features)


def state_tiers(df: DataFrame, shares: list[float]) -> DataFrame:
    """States grouped by their share of the largest state's total.

    ``shares`` are falling thresholds; tier 0 lies at or above the first one.
    """
    totals = df.groupBy(STATE).agg(F.sum(QTY).alias("total"))
    top = totals.agg(F.max("total")).scalar()
    ratio = F.col("total") / F.nullif(top, F.lit(0).cast("long"))
    tier = reduce(lambda out, x: out.when(ratio >= x[1], x[0]), list(enumerate(shares)),
                  F.when(F.lit(False), F.lit(None).cast("int")))
    return totals.withColumn("tier", tier.otherwise(len(shares)))


def interaction_key(number: Column, text: Column) -> Column:
    return F.concat_ws("_", number.cast("string"), text)
