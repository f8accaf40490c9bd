"""Descriptive statistics and diagnostics; each by any keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.windows import RANGE_ROWS, chunks, lag_, safe_div, series, with_running
from tideline.schema import KEYS, ORDER


#: Quantile sketches: rank errors are at most one in so many rows.
ACCURACY = 10_000


def quantiles(df: DataFrame, column: str, shares: Sequence[float], keys: Sequence[str] = KEYS, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, share, value): exact quantiles a key, with the mean of two values between them, by refinement.

    A sketch brackets each quantile; one more pass counts what is below the brackets and the distinct values in them, and
    the rank decides among these: no buffer holds a key's values, and repeated ones are counted together. Nulls take no part.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    edge = [min(max(s + e * 2 / accuracy, 0.0), 1.0) for s in shares for e in (-1, 1)]
    guess = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", edge, accuracy).alias("_b"))
    guess = guess.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", "_b")
    both = rows.join(guess, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    low, high = (lambda i: F.get("_b", F.lit(2 * i))), (lambda i: F.get("_b", F.lit(2 * i + 1)))
    x = F.col("_x")
    zone = lambda i: F.when(x < low(i), -1).when(x > high(i), 1).otherwise(0)
    seen = F.array(*[F.struct(F.lit(float(s)).alias("share"), zone(i).alias("zone"), F.when(zone(i) == 0, x).alias("v")) for i, s in enumerate(shares)])
    few = both.select(*keys, "_n", "_x", F.explode(seen).alias("s")).groupBy(*keys, "s.share", "s.zone", "s.v").agg(F.count("*").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys, "share").orderBy("zone", "v")
    few = few.withColumn("_upto", F.sum("_c").over(w)).withColumn("_place", F.col("share") * (F.col("_n") - 1))

    def at(place: Column) -> Column:
        """The value of a rank: in the bracket, or the one next to it."""
        here = (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
        return F.max(F.when(here & (F.col("zone") < 0), F.col("_high")).when(here, F.col("_low")))

    out = few.groupBy(*keys, "share").agg(at(F.floor("_place")).alias("_a"), at(F.ceil("_place")).alias("_b"), F.first("_place").alias("_p"))
    return out.select(*keys, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).alias("value"))


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, exact: bool = True) -> DataFrame:
    """One row a key and column: count, mean, std, min, quartiles, max. exact=False sketches the quartiles."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(*keys, "v.*")
    by, shares = [*keys, "column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    plain = {"count": F.count("x"), "mean": F.avg("x"), "std": F.stddev_samp("x"), "min": F.min("x"), "max": F.max("x")}
    if not exact:
        return long.groupBy(*by).agg(*[f.alias(c) for c, f in {**plain, **{c: F.percentile_approx("x", s) for c, s in shares.items()}}.items()]).select(*by, "count", "mean", "std", "min", *shares, "max")
    found = quantiles(long, "x", list(shares.values()), by).groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(c) for c, s in shares.items()])
    found = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})
    both = long.groupBy(*by).agg(*[f.alias(c) for c, f in plain.items()]).join(found, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], "left")
    return both.select(*by, "count", "mean", "std", "min", *shares, "max")


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))


def time_range(df: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def moments(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Population moments, excess kurtosis."""
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis"))


def residuals(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.withColumn("residual", F.col(label) - F.col(score))


def histogram(df: DataFrame, column: str, bins: int = 40, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal bins from the least to the greatest value, which is in the last one; empty bins have no row."""
    ends = df.groupBy(*keys).agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    place = F.coalesce(F.floor(safe_div((F.col(column) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))) + 1, F.lit(1))
    return df.where(F.col(column).isNotNull()).join(ends, list(keys)).groupBy(*keys, F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def probit(p: Column) -> Column:
    """Inverse of the normal distribution function (Acklam's rational approximation, relative error below 1.2e-9)."""
    # The approximation's coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(cs: Sequence[float], x: Column) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out

    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    tail = lambda u: poly(c, F.sqrt(-2 * F.ln(u))) / poly(d, F.sqrt(-2 * F.ln(u)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(poly(a, r) * q / poly(b, r))


def qq_normal(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Normal Q-Q line a key: slope, intercept and correlation of ordered values and normal order medians."""
    rows = df.where(F.col(column).isNotNull()).select(*keys, column)
    rows = with_running(rows, {"_i": F.lit(1)}, keys, column).withColumn("_i", F.col("_i") + 1)
    rows = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys))
    end = F.pow(F.lit(0.5), 1 / F.col("_n"))
    place = F.when(F.col("_i") == F.col("_n"), end).when(F.col("_i") == 1, 1 - end).otherwise((F.col("_i") - 0.3175) / (F.col("_n") + 0.365))
    rows = rows.withColumn("_q", probit(place))
    return rows.groupBy(*keys).agg(F.regr_slope(column, "_q").alias("slope"), F.regr_intercept(column, "_q").alias("intercept"), F.corr(column, "_q").alias("r"))


def acf(df: DataFrame, column: str, lags: int = 20, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """(keys, lag, acf, band): autocorrelation for lags 0 to `lags`, and 1.96 / sqrt(n)."""
    w = series(keys, order)
    x = df.where(F.col(column).isNotNull()).withColumn("_d", F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))
    x = x.withColumns({f"_l{k}": lag_(F.col("_d"), k, w) for k in range(1, lags + 1)})
    sums = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_s0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    items = F.array(*[F.struct(F.lit(k).alias("lag"), safe_div(F.col(f"_s{k}"), F.col("_s0")).alias("acf")) for k in range(lags + 1)])
    return sums.select(*keys, F.explode(items).alias("v"), (1.96 / F.sqrt("_n")).alias("band")).select(*keys, "v.*", "band")


def pacf(df: DataFrame, column: str, lags: int = 20, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """(keys, lag, pacf, band) by the Levinson-Durbin recursion on each key's few autocorrelations.

    Autocovariances are divided by the number of pairs (n - k), as in the adjusted Yule-Walker form.
    """
    rows = acf(df, column, lags, keys, order).withColumn("_m", F.pow(1.96 / F.col("band"), 2))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        n = pdf["_m"].to_numpy()
        r = pdf["acf"].to_numpy() * n / (n - pdf["lag"].to_numpy())
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k])
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pdf.assign(pacf=out)[[*keys, "lag", "pacf", "band"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", lag int, pacf double, band double")


def adf(df: DataFrame, column: str, keys: Sequence[str] = KEYS, order: str = ORDER, max_lag: int | None = None, chunk: int = RANGE_ROWS) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: (keys, statistic, used_lag, n_obs, p_value, critical_5, stationary).

    Lag orders up to 12 * (n / 100) ** (1 / 4), rounded up, and n // 2 - 2 are tried for a key of n rows
    (max_lag: up to that one). The cross products of the design are summed over chunks of a key, each with
    the rows before it that its lags need: a chunk gives one matrix, whatever the number of lags. They cover the rows that all orders
    share; an order's own rows are these and some of the key's first ones, which come beside.
    Every order is solved on the shared rows (least AIC), and the chosen one again on all its rows.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, order, F.col(column).cast("double").alias("_x"))
    n = F.col("_n")
    most = F.greatest(F.least(F.ceil(12 * F.pow(n / 100, 0.25)), F.floor(n / 2) - 2), F.lit(0)).cast("int") if max_lag is None else F.lit(max_lag)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_p", most).drop("_n")
    p = sizes.agg(F.max("_p")).first()[0] or 0
    dealt = chunks(rows, p + 1, 0, keys, order, chunk).join(sizes, list(keys))
    size = p + 3

    def products(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        x, own, place, p = (table.column(c).to_numpy() for c in ("_x", "_own", "_at", "_p"))
        most, d = int(p[0]), np.diff(x, prepend=np.nan)
        # Rows of the design: difference, value before, one, and the differences before; some of a key's first ones lack lags.
        lags = [np.concatenate([np.full(min(k, len(d)), np.nan), d[: max(0, len(d) - k)]]) for k in range(1, most + 1)]
        design = np.column_stack([d, np.append(np.nan, x[:-1]), np.ones(len(x)), *lags])
        shared = design[own & (place >= most + 1)]
        first = own & (place < most + 1)
        gram = np.zeros((size, size))
        gram[: most + 3, : most + 3] = shared.T @ shared
        early = np.zeros((int(first.sum()), size + 1))
        early[:, 0], early[:, 1 : most + 4] = place[first] + 1, np.nan_to_num(design[first])
        return pa.table([*(pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(keys, key, strict=False)), pa.array([most], pa.int32()), pa.array([gram.tobytes()], pa.binary()), pa.array([early.tobytes()], pa.binary())], names=[*keys, "_p", "_gram", "_first"])

    kinds = dict(df.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    grams = dealt.groupBy(*keys, "_chunk").applyInArrow(products, f"{named}, _p int, _gram binary, _first binary")

    def fit(gram: np.ndarray, k: int) -> tuple[float, float, float]:
        use = [1, 2, *range(3, 3 + k)]
        inv = np.linalg.pinv(gram[np.ix_(use, use)])
        b, n = gram[0, use], float(gram[2, 2])
        beta = inv @ b
        rss = max(gram[0, 0] - beta @ b, 1e-300)
        return beta[0] / math.sqrt(rss / (n - len(use)) * inv[0, 0]), n, n * math.log(rss / n) + 2 * len(use)

    # MacKinnon (1994, 2010), regression with a constant, one variable.
    def p_value(t: float) -> float:
        if t > 2.74 or t < -18.83:
            return float(t > 2.74)
        c = (2.1659, 1.4412, 0.038269) if t <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
        return 0.5 * math.erfc(-sum(v * t**k for k, v in enumerate(c)) / math.sqrt(2))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = sum(np.frombuffer(b, float).reshape(size, size) for b in pdf["_gram"])
        early = [v for b in pdf["_first"] for v in np.frombuffer(b, float).reshape(-1, size + 1)]
        k = min(range(int(pdf["_p"].iloc[0]) + 1), key=lambda q: fit(gram, q)[2])
        t, n, _ = fit(gram + sum(np.outer(v[1:], v[1:]) for v in early if v[0] >= k + 2), k)
        critical = -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3
        return pdf[list(keys)].head(1).assign(statistic=t, used_lag=k, n_obs=int(n), p_value=p_value(t), critical_5=critical, stationary=t < critical)

    return grams.groupBy(*keys).applyInPandas(solve, f"{named}, statistic double, used_lag int, n_obs long, p_value double, critical_5 double, stationary boolean")


def bias_variance_verdict(df: DataFrame, train: str, val: str) -> DataFrame:
    gap = F.col(val) - F.col(train)
    return df.withColumn("gap", gap).withColumn("verdict", F.when(F.col(train) < 0.55, "HIGH BIAS").when(gap < -0.03, "HIGH VARIANCE").otherwise("BALANCED"))
