"""Chronological protocol: splits, folds, train-only scaling and PCA, sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.windows import with_position
from tideline.schema import KEYS, LAG_COLUMNS, ORDER


def chrono_split(df: DataFrame, train: float = 0.8, val: float = 0.1, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Adds block: test from int(n * train) on, before it val from int(n * (train - val)) on, else train."""
    out = with_position(df, keys, order)
    cut = lambda share: F.floor(F.col("n") * F.lit(share))
    block = F.when(F.col("pos") > cut(train), "test").when(F.col("pos") > cut(train - val), "val").otherwise("train")
    return out.withColumn("block", block).drop("pos", "n")


def expanding_folds(df: DataFrame, k: int = 5, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Each row once for every fold that it is in, with fold (from 1) and part: train before the test block, test in it."""
    out = with_position(df, keys, order).withColumn("_size", F.floor(F.col("n") / (k + 1)))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_from", F.col("n") - (k + 1 - F.col("fold")) * F.col("_size"))
    out = out.where(F.col("pos") <= F.col("_from") + F.col("_size"))
    return out.withColumn("part", F.when(F.col("pos") > F.col("_from"), "test").otherwise("train")).drop("pos", "n", "_size", "_from")


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column (1 where it is 0): two numbers a column on the driver."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in params.items()})


def fit_lag_pca(train: DataFrame, columns: Sequence[str] = LAG_COLUMNS, threshold: float = 0.95) -> dict:
    """Scaler and the fewest components with more than threshold of the variance, from one aggregate of covariances."""
    n = len(columns)
    rows = train.na.drop("any", subset=list(columns))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    got = rows.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    cov = np.zeros((n, n))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    sd = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    values, vectors = values[::-1].clip(0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(n)])
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    k = min(n, int(np.searchsorted(share, threshold, "right")) + 1)
    return {"columns": list(columns), "mean": [got[f"m{i}"] or 0.0 for i in range(n)], "sd": sd.tolist(), "components": vectors[:, :k].T.tolist(), "explained": (values[:k] / max(values.sum(), 1e-300)).tolist()}


def apply_lag_pca(df: DataFrame, params: dict) -> DataFrame:
    """The lag block replaced by lag_pca_1 to lag_pca_k, as plain linear expressions."""
    scaled = [(F.col(c) - m) / s for c, m, s in zip(params["columns"], params["mean"], params["sd"], strict=True)]
    new = {f"lag_pca_{k}": sum((x * float(w) for x, w in zip(scaled, row, strict=True)), F.lit(0.0)) for k, row in enumerate(params["components"], 1)}
    return df.withColumns(new).drop(*params["columns"])


def sequences(df: DataFrame, columns: Sequence[str], steps: int = 20, labels: Sequence[str] = (), block: str = "block", keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """(keys, block, order, seq, labels): the last `steps` rows of each row within its block; the block's last window is left out."""
    w = Window.partitionBy(*keys, block)
    seq = F.collect_list(F.array(*columns)).over(w.orderBy(order).rowsBetween(1 - steps, 0))
    out = df.withColumn("seq", seq).withColumn("_pos", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return out.where((F.size("seq") == steps) & (F.col("_pos") < F.col("_n"))).select(*keys, block, order, "seq", *labels)
