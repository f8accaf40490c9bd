"""Spark ML's own classifiers, and the scores of any model. Searches, boosted sums and forests: see boosting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.metrics import accuracy, prf, regression_errors, roc_auc
from tideline.operators.boosting import TreeModel
from tideline.operators.sequence_net import SequenceNet

#: Rows that one task of a fit should have at least.
ROWS = 100_000

#: The columns of holdout.
SCORES = ("accuracy", "precision", "recall", "f1", "roc_auc")


def class_weights(df: DataFrame, label: str) -> Column:
    """The weight that gives every class the same sum: rows / (classes * rows of the class)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    pairs = [F.lit(x) for k, n in counts.items() if k is not None for x in (k, sum(counts.values()) / (len(counts) * n))]
    return F.create_map(*pairs)[F.col(label)] if pairs else F.lit(1.0)


def fit_direction(
    df: DataFrame, columns: Sequence[str], label: str = "target_direction", trees: int = 20, depth: int = 3, rate: float = 0.1, kind: str = "gbt", seed: int = 42,
    leaf: int = 1, sample: float | None = None, features: str | None = None, balanced: bool = False,
):
    """Boosted (gbt, gbt_subsample), forest or logistic classifier of the next bar's direction.

    leaf is the least number of rows in a leaf, sample the share of rows a tree sees, features the
    columns a split may choose from (Spark's featureSubsetStrategy). balanced weighs rows so that the
    classes count alike.
    """
    common = {"labelCol": label, "featuresCol": "features"}
    if balanced:
        df, common = df.withColumn("_weight", class_weights(df, label)), {**common, "weightCol": "_weight"}
    trained = {"maxDepth": depth, "minInstancesPerNode": leaf, "seed": seed}
    model = {
        "gbt": lambda: GBTClassifier(maxIter=trees, stepSize=rate, subsamplingRate=sample or 1.0, featureSubsetStrategy=features or "all", **trained, **common),
        "gbt_subsample": lambda: GBTClassifier(maxIter=trees, stepSize=rate, subsamplingRate=sample or 0.8, featureSubsetStrategy=features or "0.8", **trained, **common),
        "forest": lambda: RandomForestClassifier(numTrees=trees, subsamplingRate=sample or 1.0, featureSubsetStrategy=features or "auto", **trained, **common),
        "logistic": lambda: LogisticRegression(maxIter=trees, **common),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), model]).fit(df)


def scored(model, df: DataFrame) -> DataFrame:
    """Adds prediction (int) and probability (of class 1)."""
    if isinstance(model, TreeModel | SequenceNet):
        return model.transform(df)
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")[1]).withColumn("prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction")


def holdout(df: DataFrame, model, label: str = "target_direction") -> DataFrame:
    """One row: accuracy, precision, recall, f1, roc_auc over all rows."""
    s = _shared(scored(model, df).select(label, "prediction", "probability", F.lit(1).alias("_")))
    return accuracy(s, label, "prediction", ["_"]).join(prf(s, label, "prediction", ["_"]), "_").join(roc_auc(s, label, "probability", ["_"]), "_").drop("_")


def _shared(df: DataFrame) -> DataFrame:
    """A label and scores, written once where the session has a folder for that, else kept in memory."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def sized(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df kept in memory, in no more tasks than its rows call for: each tree takes a job a level."""
    df = df.persist()
    return df.coalesce(max(1, -(-df.count() // rows)))


def cross_validate(folds: DataFrame, fit: Callable[[DataFrame], object], label: str = "target_direction") -> DataFrame:
    """(scores, fold) of any fit, fold by fold, on the rows of expanding_folds: for models that don't grow together."""
    out = None
    for k in [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        rows = folds.where(F.col("fold") == k)
        one = holdout(rows.where("part = 'test'"), fit(rows.where("part = 'train'")), label).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def regression_scores(df: DataFrame, model, label: str = "target_return", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return regression_errors(model.transform(df), label, "predicted_return", keys)
