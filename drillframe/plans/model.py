"""Boosted-tree regression of progress on features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillframe.operators.durable import discard, stored
from drillframe.operators.sampling import exact_share
from drillframe.plans import forest
from drillframe.plans.forest import RandomForestRegressor, Tree

#: Settings of the model across keys and of the one within; patience: trees without improvement that end it.
ACROSS = {"maxIter": 500, "maxDepth": 6, "minInstancesPerNode": 20, "validation": 0.15, "patience": 30}
WITHIN = {"maxIter": 400, "maxDepth": 5, "minInstancesPerNode": 30, "validation": 0.10, "patience": 20}
#: The share of a tree's prediction that is added, and the trees of one round, all fitted on the same residual.
RATE, AT_ONCE = 0.05, 5
#: Candidate splits of a feature.
BINS = 128


@dataclass(frozen=True)
class Boosted:
    """The mean of the labels and the trees that are added to it. errors: mean square on the validation rows after each
    round, that of the mean alone first; fitted: trees that were fitted, kept or not."""

    assembler: VectorAssembler
    mean: float
    trees: GBTRegressionModel | None
    errors: tuple[float, ...]
    fitted: int


def holdout(df: DataFrame, share: float, keys: Sequence[str] = ("well_name", "ts"), name: str = "is_validation") -> DataFrame:
    """A validation flag on exactly int(share * rows) rows, without replacement, by a hash of the row's key."""
    return exact_share(df, share, keys, name)


def fit(train: DataFrame, features: Sequence[str], label: str = "rop", settings: dict | None = None) -> Boosted:
    """Trees fitted on what the mean and the trees before them leave of the label, a stored column, up to maxIter.

    Features are cut into bins once. A round fits AT_ONCE trees on one residual, each on its own sample of rows, and adds
    RATE of each: every pass over the rows grows them all. No tree is fitted twice: the next round goes on from the residual,
    stored anew after each. It ends once `patience` trees have brought no improvement on the validation rows, which no tree
    is fitted on, and keeps the trees up to the best round. Without validation rows all maxIter trees are kept; without
    rows there are none, and the mean is 0.
    """
    chosen = dict(ACROSS if settings is None else settings)
    share, patience, most = (chosen.pop(k) for k in ("validation", "patience", "maxIter"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    keys = [c for c in ("well_name", "ts") if c in train.columns]
    labelled = train.where(F.col(label).isNotNull()).select(*keys, *features, F.col(label).cast("double").alias("_left"))
    whole = holdout(labelled, share, keys)
    mean = whole.where("NOT is_validation").agg(F.avg("_left")).first()[0] or 0.0
    edges = forest.cuts(whole.where("NOT is_validation"), features, BINS)
    drawn = whole.withColumns({"_left": F.col("_left") - mean, "_draw": F.xxhash64(*keys, *features, "_left")})
    rows = stored(forest.binned(drawn, features, edges).repartition(train.sparkSession.sparkContext.defaultParallelism))
    discard(whole)
    square = lambda: forest.mean_square(rows.where("is_validation"))
    start = square()
    errors, trees, best = [start], [], 0
    some = not rows.where("NOT is_validation").isEmpty()
    while some and len(trees) < most:
        n = min(AT_ONCE, most - len(trees))
        learner = RandomForestRegressor(len(features), BINS, numTrees=n, seed=42 + len(trees), **chosen)
        new = learner.fit(rows.where("NOT is_validation"))
        trees += new
        before, rows = rows, stored(forest.less(rows, new, RATE))
        discard(before)
        if start is not None:
            errors.append(square())
            best = errors.index(min(errors))
            if (len(errors) - 1 - best) * AT_ONCE >= patience:
                break
    discard(rows)
    fitted = len(trees)
    return Boosted(assembler, mean, _ensemble(trees[: best * AT_ONCE] if start is not None else trees, edges), tuple(errors if start is not None else ()), fitted)


def _ensemble(trees: Sequence[Tree], edges: Sequence[Sequence[float]]) -> GBTRegressionModel | None:
    """The model that adds RATE of each tree, as Spark's own. Spark's Python side has no constructor for it."""
    if not trees:
        return None
    gateway = SparkContext._active_spark_context._gateway
    ml, double = gateway.jvm.org.apache.spark.ml, gateway.jvm.double
    stats = lambda: gateway.new_array(double, 3)
    none = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats(), 0)

    def node(tree: Tree, i: int):
        value, feature = float(tree.value[i]), int(tree.feature[i])
        if feature < 0:
            return ml.tree.LeafNode(value, 0.0, none)
        # Importances weigh a split's gain by its rows.
        counted = stats()
        counted[0] = float(tree.rows[i])
        about = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(counted, int(tree.rows[i]))
        split = ml.tree.ContinuousSplit(feature, float(edges[feature][tree.cut[i]]))
        return ml.tree.InternalNode(value, 0.0, float(tree.gain[i]), node(tree, 2 * i + 1), node(tree, 2 * i + 2), split, about)

    own, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees)), gateway.new_array(double, len(trees))
    for i, tree in enumerate(trees):
        own[i], weights[i] = ml.regression.DecisionTreeRegressionModel(f"tree_{i}", node(tree, 0), len(edges)), RATE
    return GBTRegressionModel(ml.regression.GBTRegressionModel("boosted", own, weights, len(edges))).setPredictionCol("pred_rop")


def n_trees(model: Boosted) -> int:
    """The number of trees that early stopping has kept."""
    return model.trees.getNumTrees if model.trees else 0


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    if model.trees is None:
        return df.withColumn("pred_rop", F.lit(model.mean))
    return model.trees.transform(model.assembler.transform(df)).withColumn("pred_rop", F.col("pred_rop") + model.mean).drop("features")


def importances(model: Boosted, n: int = 25) -> DataFrame:
    """place, feature and importance of the n features that tell most: one row a feature, whatever the data."""
    names = model.assembler.getInputCols()
    shares = model.trees.featureImportances.toArray().tolist() if model.trees else [0.0] * len(names)
    found = sorted(zip(names, shares), key=lambda x: (-x[1], x[0]))
    rows = [(i, f, x) for i, (f, x) in enumerate(found[:n], 1)]
    return SparkSession.active().createDataFrame(rows, "place int, feature string, importance double").orderBy("place")
