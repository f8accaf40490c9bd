"""Evaluation metrics of (label, prediction or score), by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.windows import safe_div, with_running
from tideline.schema import KEYS


def accuracy(df: DataFrame, y: str, p: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def prf(df: DataFrame, y: str, p: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision, recall and F1 of class 1; 0 where undefined."""
    tp, pred, real = F.count_if((F.col(y) == 1) & (F.col(p) == 1)), F.count_if(F.col(p) == 1), F.count_if(F.col(y) == 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(zero(safe_div(tp, pred)).alias("precision"), zero(safe_div(tp, real)).alias("recall"), zero(safe_div(2 * tp, pred + real)).alias("f1"))


def roc_auc(df: DataFrame, y: str, s: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact, ties count half; null with one class only. Rows collapse to distinct scores, which are dealt by ranges."""
    by = df.where(F.col(y).isNotNull() & F.col(s).isNotNull()).groupBy(*keys, s).agg(F.sum(F.col(y).cast("double")).alias("_p"), F.sum(1.0 - F.col(y)).alias("_n"))
    by = with_running(by, {"_below": F.col("_n")}, keys, s)
    return by.withColumn("_u", F.col("_p") * (F.col("_below") + F.col("_n") / 2)).groupBy(*keys).agg(safe_div(F.sum("_u"), F.sum("_p") * F.sum("_n")).alias("roc_auc"))


def regression_errors(df: DataFrame, y: str, p: str, keys: Sequence[str] = KEYS) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def confusion(df: DataFrame, y: str, p: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys, F.col(y).alias("label"), F.col(p).alias("prediction")).agg(F.count("*").alias("count"))


def class_report(df: DataFrame, y: str, p: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision, recall, F1 and support of each class, then their macro and weighted means."""
    cells = confusion(df, y, p, keys)
    sides = cells.select(*keys, F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("class"), F.lit(c == "label").alias("real")) for c in ("label", "prediction")])).alias("v"), (F.col("label") == F.col("prediction")).alias("hit"), "count").select(*keys, "v.*", "hit", "count")
    n = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    by = sides.groupBy(*keys, "class").agg(n(F.col("real") & F.col("hit")).alias("_tp"), n(~F.col("real")).alias("_pred"), n(F.col("real")).alias("support"))
    zero = lambda a, b: F.coalesce(safe_div(a, b), F.lit(0.0))
    tp = F.col("_tp")
    rows = by.select(*keys, "class", zero(tp, F.col("_pred")).alias("precision"), zero(tp, F.col("support")).alias("recall"), zero(2 * tp, F.col("_pred") + F.col("support")).alias("f1"), "support")
    scores = ("precision", "recall", "f1")
    macro = rows.groupBy(*keys).agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = rows.groupBy(*keys).agg(F.lit("weighted avg").alias("class"), *[safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def mean_baseline(df: DataFrame, y: str, p: str, keys: Sequence[str] = KEYS, train: DataFrame | None = None) -> DataFrame:
    """MAE of the model and of always predicting the mean (the block's own, or of train), std ratio, correlation, verdict."""
    mean = (df if train is None else train).groupBy(*keys).agg(F.avg(y).alias("_m"))
    out = df.join(mean, list(keys)).groupBy(*keys).agg(
        F.avg(F.abs(F.col(y) - F.col("_m"))).alias("baseline_mae"), F.avg(F.abs(F.col(y) - F.col(p))).alias("model_mae"),
        safe_div(F.stddev_pop(p), F.stddev_pop(y)).alias("std_ratio"), F.corr(y, p).alias("corr"),
    )
    gain = F.col("baseline_mae") - F.col("model_mae")
    return out.withColumn("verdict", F.when(F.abs(gain) < 0.01, "same as baseline").when(gain > 0, "better").otherwise("worse"))


def comparison_table(fold_scores: DataFrame, holdout: DataFrame | None = None, metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1", "roc_auc")) -> DataFrame:
    mean = fold_scores.groupBy("model").agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])
    return mean if holdout is None else mean.unionByName(holdout.select("model", *[F.round(m, 4).alias(m) for m in metrics]))


def best_by(df: DataFrame, metric: str, name: str = "model") -> DataFrame:
    return df.agg(F.max_by(name, metric).alias(name), F.max(metric).alias(metric))


def rank_of(importances: DataFrame, name: str) -> DataFrame:
    """Place of a feature by importance; the table is one row a feature."""
    return importances.withColumn("rank", F.rank().over(Window.orderBy(F.desc("importance")))).where(F.col("feature") == name)


def ablation_table(with_: DataFrame, without: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row each for without, with and the difference, rounded to four digits."""
    a, b = without.select(*[F.col(m).alias(f"a_{m}") for m in metrics]), with_.select(*[F.col(m).alias(f"b_{m}") for m in metrics])
    rows = F.array(*[F.struct(F.lit(n).alias("run"), *[F.round(f(m), 4).alias(m) for m in metrics]) for n, f in (("without", lambda m: F.col(f"a_{m}")), ("with", lambda m: F.col(f"b_{m}")), ("delta", lambda m: F.col(f"b_{m}") - F.col(f"a_{m}")))])
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").select(F.explode(rows).alias("r")).select("r.*")
