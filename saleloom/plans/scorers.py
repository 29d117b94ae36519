"""Fitted models as column expressions, for plans that call a model inside another expression.

Boosted trees become five flat arrays: every node's feature, threshold (a leaf's value), left and right
child, and the roots with their weights. The arrays are one row that joins the series as a column, so an
expression can walk the trees for as many steps as a forecast has without leaving its stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import RobustScalerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREST = ("feature array<int>, threshold array<double>, left array<int>, right array<int>, roots array<int>, "
          "weights array<double>, center array<double>, width array<double>, depth int")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Linear:
    """A weighted sum of inputs. ``hot`` has weights by code for coded columns, whose unseen codes weigh nothing."""

    weights: dict[str, float]
    constant: float = 0.0
    hot: dict[str, dict[int, float]] = field(default_factory=dict)

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the sum of their codes' weights: a join with one row for each weight."""
        total, added = F.lit(0.0), []
        for i, (column, by_code) in enumerate(self.hot.items()):
            table = rows.sparkSession.createDataFrame(list(by_code.items()), f"_code_{i} long, _hot_{i} double")
            rows = rows.join(table, F.col(column) == F.col(f"_code_{i}"), "left")
            total, added = total + F.coalesce(F.col(f"_hot_{i}"), F.lit(0.0)), [*added, f"_code_{i}", f"_hot_{i}"]
        return rows.withColumn("_hot", total).drop(*added) if self.hot else rows

    def column(self, inputs: dict[str, Column]) -> Column:
        """The score of a row of ``attach``; ``inputs`` holds an expression for each input."""
        total = F.lit(float(self.constant))
        for name, weight in self.weights.items():
            total = total + F.lit(float(weight)) * inputs[name].cast("double")
        return total + F.col("_hot") if self.hot else total

    def transform(self, df: DataFrame) -> DataFrame:
        """The score as ``prediction``, like a fitted model."""
        out = self.attach(df).withColumn("prediction", self.column({n: F.col(f"`{n}`") for n in self.weights}))
        return out.drop("_hot")


@dataclass(frozen=True)
class Forest:
    """A weighted sum of regression trees over named inputs, each first centred and divided by its width."""

    inputs: list[str]
    arrays: dict[str, list | int]

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the arrays as the column ``_forest``; the arrays are one row, of a model's size."""
        names = re.findall(r"(\w+) (?:array|int)", FOREST)
        table = rows.sparkSession.createDataFrame([(1, tuple(self.arrays[n] for n in names))], f"_one int, _forest struct<{FOREST}>")
        return rows.withColumn("_key", F.lit(1)).join(F.broadcast(table), F.col("_key") == F.col("_one")).drop("_key", "_one")

    def column(self, inputs: dict[str, Column]) -> Column:
        forest = F.col("_forest")
        raw = F.array(*[inputs[n].cast("double") for n in self.inputs])
        scaled = F.zip_with(F.zip_with(raw, forest["center"], lambda x, c: x - c), forest["width"],
                            lambda x, w: F.when(w == 0, F.lit(0.0)).otherwise(x / w)) if self.arrays["center"] else raw

        def down(x: Column, node: Column) -> Column:
            at = F.get(forest["feature"], node)
            side = F.when(F.get(x, at) <= F.get(forest["threshold"], node), F.get(forest["left"], node)).otherwise(
                F.get(forest["right"], node))
            return F.when(at < 0, node).otherwise(side)

        def leaf(x: Column, root: Column) -> Column:
            return F.get(forest["threshold"], F.aggregate(F.sequence(F.lit(1), forest["depth"]), root, lambda node, _: down(x, node)))

        def total(x: Column) -> Column:
            return F.aggregate(F.arrays_zip(forest["roots"], forest["weights"]), F.lit(0.0),
                               lambda s, t: s + t["weights"] * leaf(x, t["roots"]))

        return let(scaled, total)


Scorer = Linear | Forest


def trees_of_text(text: str) -> dict[str, list | int]:
    """The arrays of a boosted model from Spark's description of its trees."""
    out: dict[str, list | int] = {n: [] for n in ("feature", "threshold", "left", "right", "roots", "weights")}
    deepest, open_nodes = 0, []  # nodes whose left or right side is still to come

    def add(feature: int, threshold: float) -> int:
        out["feature"].append(feature)
        out["threshold"].append(threshold)
        out["left"].append(-1)
        out["right"].append(-1)
        node = len(out["feature"]) - 1
        if open_nodes:
            parent, side = open_nodes[-1]
            out[side][parent] = node
        return node

    for line in map(str.strip, text.splitlines()[1:]):
        if tree := re.fullmatch(r"Tree \d+ \(weight (\S+)\):", line):
            out["weights"].append(float(tree[1]))
            out["roots"].append(len(out["feature"]))
            open_nodes = []
        elif split := re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line):
            open_nodes.append((add(int(split[1]), float(split[2])), "left"))
            deepest = max(deepest, len(open_nodes))
        elif re.fullmatch(r"Else \(feature \d+ > \S+\)", line):
            while open_nodes[-1][1] == "right":
                open_nodes.pop()
            open_nodes[-1] = (open_nodes[-1][0], "right")
        elif value := re.fullmatch(r"Predict: (\S+)", line):
            add(-1, float(value[1]))
            while open_nodes and open_nodes[-1][1] == "right":
                open_nodes.pop()
        else:
            raise ValueError(f"not a line of a tree on numbers: {line!r}")
    return out | {"depth": max(1, deepest)}


def compiled(model: PipelineModel | Linear | Forest, hot: dict[str, tuple[str, int]] | None = None) -> Scorer:
    """The expression form of an assembler, an optional robust scaler and boosted trees or a linear model.

    ``hot`` names inputs that are one-hot vectors: the coded column each was made from and its number of codes.
    """
    if isinstance(model, (Linear, Forest)):
        return model
    assemble, *scalers, last = model.stages
    if not isinstance(assemble, VectorAssembler) or not all(isinstance(s, RobustScalerModel) for s in scalers):
        raise TypeError("no expression form for these stages")
    names = assemble.getInputCols()
    if isinstance(last, GBTRegressionModel) and not hot:
        arrays = trees_of_text(last.toDebugString) | {"center": [], "width": []}
        for scaler in scalers:
            n = len(names)
            arrays["center"] = scaler.median.toArray().tolist() if scaler.getWithCentering() else [0.0] * n
            arrays["width"] = scaler.range.toArray().tolist() if scaler.getWithScaling() else [1.0] * n
        return Forest(names, arrays)
    if isinstance(last, LinearRegressionModel) and not scalers:
        weights, by_code, at = {}, {}, 0
        values = last.coefficients.toArray().tolist()
        for name in names:
            column, size = (hot or {}).get(name, ("", 1))
            if column:
                by_code[column] = {i: w for i, w in enumerate(values[at:at + size]) if w}
            else:
                weights[name] = values[at]
            at += size
        return Linear(weights, float(last.intercept), by_code)
    raise TypeError(f"no expression form for {type(last).__name__}")
