"""Training inside every fold of a rolling-origin evaluation.

Folds overlap: each trains on ``train_days`` days and the next one starts ``step_days`` later. No fold reads its
rows. A series' rows are summed once by blocks of days into what least squares needs, the sums of products of
its inputs, and what a fold trains on is the difference of two running totals of these sums. The system of a
fold is then solved by column expressions, so all folds of all series are one shuffle of small rows.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleloom.operators import summary
from saleloom.schema import DATE, PRED, QTY, SERIES

NOTHING = 1e-12  # what is left of an input's own square, as a share, below which it says nothing new


def _products(inputs: list[str], label: str) -> dict[str, Column]:
    """Names and expressions of the sums that a fit needs."""
    known = F.lit(True)
    for c in [*inputs, label]:
        known = known & F.col(c).isNotNull()
    columns = {f"_s{i}": F.col(c) for i, c in enumerate(inputs)} | {"_sy": F.col(label)}
    pairs = list(combinations_with_replacement(range(len(inputs)), 2))
    columns |= {f"_s{i}_{j}": F.col(inputs[i]) * F.col(inputs[j]) for i, j in pairs}
    columns |= {f"_s{i}_y": F.col(c) * F.col(label) for i, c in enumerate(inputs)}
    return {"_n": F.when(known, F.lit(1).cast("long"))} | {n: F.when(known, c) for n, c in columns.items()}


def fold_sums(df: DataFrame, inputs: list[str], train_days: int = 180, test_days: int = 30, step_days: int = 30,
              series: list[str] = SERIES, label: str = QTY) -> DataFrame:
    """series, fold and the sums of products over the fold's training days.

    Rows with a null input or label are left out. Folds are those of ``summary.rolling_origin``: fold k
    trains on ``train_days`` days from the first day of all series + k * step. Sums of whole numbers are exact.
    """
    block_days = math.gcd(train_days, test_days, step_days)
    reach, step = train_days // block_days, step_days // block_days
    span = df.agg(F.struct(F.min(DATE).alias("a"), F.max(DATE).alias("b")).alias("s")).scalar()
    last = F.floor((F.datediff(span.getField("b"), span.getField("a")) - train_days - test_days + 1) / step_days).cast("int")
    products = _products(inputs, label)
    blocks = (df.withColumn("_block", F.floor(F.datediff(DATE, span.getField("a")) / block_days).cast("int"))
              .groupBy(*series, "_block").agg(*[F.sum(c).alias(n) for n, c in products.items()]))
    origins = (blocks.select(*series).distinct()
               .withColumn("fold", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
               .withColumn("_block", F.col("fold") * step + reach))
    rows = blocks.unionByName(origins, allowMissingColumns=True)
    w = Window.partitionBy(*series).orderBy("_block")
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    older = w.rangeBetween(Window.unboundedPreceding, -1 - reach)

    def within(name: str) -> Column:
        kind = blocks.schema[name].dataType
        none = F.lit(0).cast(kind)
        return F.coalesce(F.sum(name).over(before), none) - F.coalesce(F.sum(name).over(older), none)

    return (rows.select(*series, "fold", *[within(n).alias(n) for n in products])
            .filter(F.col("fold").isNotNull() & (F.col("_n") > 0)))


def fold_fits(df: DataFrame, inputs: list[str], train_days: int = 180, test_days: int = 30, step_days: int = 30,
              series: list[str] = SERIES, label: str = QTY) -> DataFrame:
    """series, fold, n, intercept and a weight for each input: least squares on the fold's training days.

    An input that is constant there, or follows from those before it, gets the weight 0; without any
    other the intercept is the mean. A series without training rows in a fold has no row for it.
    """
    p = len(inputs)
    sums = fold_sums(df, inputs, train_days, test_days, step_days, series, label)
    n = F.col("_n")

    def centred(a: str, b: str, both: str) -> Column:
        return (n * F.col(both) - F.col(a) * F.col(b)).cast("double")

    system = sums.withColumns(
        {f"_a{i}_{j}": centred(f"_s{i}", f"_s{j}", f"_s{i}_{j}") for i, j in combinations_with_replacement(range(p), 2)}
        | {f"_a{i}_y": centred(f"_s{i}", "_sy", f"_s{i}_y") for i in range(p)})
    system = system.withColumns({f"_own{i}": F.col(f"_a{i}_{i}") for i in range(p)})
    for k in range(p):  # elimination; the matrix is symmetric and never negative, so its diagonal can lead
        useful = F.col(f"_a{k}_{k}") > NOTHING * F.col(f"_own{k}")
        system = system.withColumn(f"_use{k}", useful)
        share = {j: F.when(useful, F.col(f"_a{k}_{j}") / F.col(f"_a{k}_{k}")).otherwise(0.0) for j in range(k + 1, p)}
        changed = {f"_a{i}_{j}": F.col(f"_a{i}_{j}") - share[i] * F.col(f"_a{k}_{j}")
                   for i, j in combinations_with_replacement(range(k + 1, p), 2)}
        changed |= {f"_a{i}_y": F.col(f"_a{i}_y") - share[i] * F.col(f"_a{k}_y") for i in range(k + 1, p)}
        system = system.withColumns(changed) if changed else system
    for k in reversed(range(p)):
        rest = F.col(f"_a{k}_y")
        for j in range(k + 1, p):
            rest = rest - F.col(f"_a{k}_{j}") * F.col(f"weight_{inputs[j]}")
        system = system.withColumn(f"weight_{inputs[k]}", F.when(F.col(f"_use{k}"), rest / F.col(f"_a{k}_{k}")).otherwise(0.0))
    told = F.lit(0.0)
    for i, c in enumerate(inputs):
        told = told + F.col(f"weight_{c}") * F.col(f"_s{i}")
    return system.select(*series, "fold", n.alias("n"), ((F.col("_sy") - told) / n).alias("intercept"),
                         *[f"weight_{c}" for c in inputs])


def refit_each_fold(df: DataFrame, inputs: list[str], train_days: int = 180, test_days: int = 30, step_days: int = 30,
                    series: list[str] = SERIES, label: str = QTY) -> DataFrame:
    """The test rows of every fold with the prediction of that fold's own fit (null without one, or without inputs)."""
    fits = fold_fits(df, inputs, train_days, test_days, step_days, series, label)
    rows = summary.rolling_origin(df, train_days, test_days, step_days).withColumn("fold", F.col("fold").cast("int"))
    predicted = F.col("intercept")
    for c in inputs:
        predicted = predicted + F.col(f"weight_{c}") * F.col(c)
    return rows.join(fits, [*series, "fold"], "left").select(*df.columns, "fold", predicted.alias(PRED))
