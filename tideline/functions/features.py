"""Feature columns, and the sets made of them. w is the window of a series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.windows import alpha_of, diff, lag_, lead_, pct_change, rolling_max, rolling_mean, rolling_min, rolling_std, safe_div, series, with_ewm, zero_to_null
from tideline.operators.align import merge_macro
from tideline.schema import FEATURE_COLUMNS, KEYS, ORDER
from tideline.sources.bars import append_bar, tail_n


def log_return(w: WindowSpec) -> Column:
    return F.ln(safe_div(F.col("close"), lag_(F.col("close"), 1, w)))


def sma(n: int, w: WindowSpec) -> Column:
    return rolling_mean(F.col("close"), n, w)


def volatility(n: int, w: WindowSpec) -> Column:
    """Of the column log_return."""
    return rolling_std(F.col("log_return"), n, w)


def bar_dynamics(guard: bool = True) -> Column:
    return safe_div(F.col("high") - F.col("low"), zero_to_null(F.col("open")) if guard else F.col("open"))


def lags(column: str, prefix: str, ks: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"{prefix}_{k}": lag_(F.col(column), k, w) for k in ks}


def cyclic(part: str, period: int) -> tuple[Column, Column]:
    """Sine and cosine of weekday (Monday 0) or month."""
    turn = {"weekday": F.weekday(ORDER), "month": F.month(ORDER)}[part] * F.lit(2 * math.pi / period)
    return F.sin(turn), F.cos(turn)


def true_range(w: WindowSpec) -> Column:
    before = lag_(F.col("close"), 1, w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def bb_width(n: int, k: float, w: WindowSpec) -> Column:
    return safe_div(2 * k * rolling_std(F.col("close"), n, w), rolling_mean(F.col("close"), n, w))


def bb_pct_b(n: int, k: float, w: WindowSpec) -> Column:
    mid, band = rolling_mean(F.col("close"), n, w), k * rolling_std(F.col("close"), n, w)
    return safe_div(F.col("close") - (mid - band), 2 * band)


def dist_sma(n: int, w: WindowSpec) -> Column:
    return safe_div(F.col("close") - sma(n, w), sma(n, w))


def stochastic(n: int, w: WindowSpec) -> Column:
    low = rolling_min(F.col("low"), n, w)
    return 100 * safe_div(F.col("close") - low, rolling_max(F.col("high"), n, w) - low)


def williams_r(n: int, w: WindowSpec) -> Column:
    high = rolling_max(F.col("high"), n, w)
    return -100 * safe_div(high - F.col("close"), high - rolling_min(F.col("low"), n, w))


def roc(n: int, w: WindowSpec) -> Column:
    return 100 * pct_change(F.col("close"), n, w)


def target_return(w: WindowSpec) -> Column:
    """The next bar's return in percent."""
    return safe_div(lead_(F.col("close"), 1, w) - F.col("close"), F.col("close")) * 100


def target_direction(ret: Column) -> Column:
    return F.when(ret.isNotNull(), (ret > 0).cast("int"))


def target_updown(w: WindowSpec, last_row: str = "drop") -> Column:
    up = (lead_(F.col("close"), 1, w) > F.col("close")).cast("int")
    return F.coalesce(up, F.lit(0)) if last_row == "zero" else up


def target_log_return(w: WindowSpec) -> Column:
    return lead_(F.col("log_return"), 1, w)


def with_atr(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    return with_ewm(df.withColumn("_tr", true_range(series(keys, order))), {f"ATR_{n}": ("_tr", alpha_of(com=n - 1))}, keys, order).drop("_tr")


def with_rsi(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    move = diff(F.col("close"), series(keys, order))
    out = df.withColumn("_up", F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))).withColumn("_down", F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))))
    a = alpha_of(com=n - 1)
    out = with_ewm(out, {"_gain": ("_up", a), "_loss": ("_down", a)}, keys, order)
    return out.withColumn(f"RSI_{n}", 100 - safe_div(F.lit(100.0), 1 + safe_div(F.col("_gain"), zero_to_null(F.col("_loss"))))).drop("_up", "_down", "_gain", "_loss")


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    out = with_ewm(df, {"_fast": ("close", alpha_of(span=fast)), "_slow": ("close", alpha_of(span=slow))}, keys, order)
    out = with_ewm(out.withColumn("MACD", F.col("_fast") - F.col("_slow")), {"MACD_signal": ("MACD", alpha_of(span=signal))}, keys, order)
    return out.withColumn("MACD_hist", F.col("MACD") - F.col("MACD_signal")).drop("_fast", "_slow")


def compute_features(bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """The feature contract, next to the key, time and volume; no targets, no rows dropped."""
    w = series(keys, order)
    day, month = cyclic("weekday", 7), cyclic("month", 12)
    out = bars.withColumns({"log_return": log_return(w), "bar_dynamics": bar_dynamics(), **{f"SMA_{n}": sma(n, w) for n in (21, 50, 100, 200)}, "BB_width": bb_width(20, 2, w), "day_sin": day[0], "day_cos": day[1], "month_sin": month[0], "month_cos": month[1]})
    out = out.withColumns({"volatility_20": volatility(20, w), **lags("log_return", "return_lag", (1, 2, 3), w), **lags("bar_dynamics", "dynamics_lag", (1, 2, 3), w)})
    return with_atr(out, 14, keys, order).select(*keys, order, *FEATURE_COLUMNS, *(["tick_volume"] if "tick_volume" in bars.columns else []))


def training_features(bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """compute_features with both targets; rows with any null are dropped (199 warm-up rows and the last one)."""
    out = compute_features(bars, keys, order).withColumn("target_return", target_return(series(keys, order)))
    return out.withColumn("target_direction", target_direction(F.col("target_return"))).na.drop("any")


def basic_features(bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, last_row: str = "drop") -> DataFrame:
    w = series(keys, order)
    day = cyclic("weekday", 7)
    out = bars.withColumns({"log_return": log_return(w), "bar_dynamics": bar_dynamics(False), **{f"SMA_{n}": sma(n, w) for n in (21, 50, 100, 200)}, "day_sin": day[0], "day_cos": day[1], "target": target_updown(w, last_row)})
    return out.withColumns({"volatility_20": volatility(20, w), **lags("log_return", "return_lag", (1, 2, 3), w), **lags("bar_dynamics", "dynamics_lag", (1, 2, 3), w)}).na.drop("any")


def indicator_features(bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, last_row: str = "drop") -> DataFrame:
    """The rich exploratory set of about 40 indicators."""
    w = series(keys, order)
    out = bars.withColumns({"log_return": log_return(w), **{f"SMA_{n}": sma(n, w) for n in (21, 50, 100, 200)}, **{f"dist_SMA_{n}": dist_sma(n, w) for n in (21, 50, 100, 200)}, "BB_bandwidth": bb_width(20, 2, w), "BB_pct_b": bb_pct_b(20, 2, w), "Stoch_K": stochastic(14, w), "Williams_R": williams_r(14, w), "ROC_10": roc(10, w), "hour_of_day": F.hour(order), "day_of_week": F.weekday(order), "target": target_updown(w, last_row)})
    r = F.col("log_return")
    out = out.withColumns({"volatility_20": volatility(20, w), "volatility_5": volatility(5, w), "Stoch_D": rolling_mean(F.col("Stoch_K"), 3, w), **lags("log_return", "lag", range(1, 6), w), **{f"return_mean_{n}": rolling_mean(r, n, w) for n in (5, 10)}, **{f"return_std_{n}": rolling_std(r, n, w) for n in (5, 10)}})
    return with_macd(with_rsi(with_atr(out, 14, keys, order), 14, keys, order), keys=keys, order=order).na.drop("any")


def eda_features(bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    w = series(keys, order)
    day = cyclic("weekday", 5)
    out = bars.withColumns({"log_return": log_return(w), "bar_dynamics": bar_dynamics(False), "day_of_week": F.weekday(order), "day_sin": day[0], "day_cos": day[1]})
    return out.withColumns({**lags("log_return", "lag", range(1, 6), w), "bar_dynamics_lag_1": lag_(F.col("bar_dynamics"), 1, w), "target_return": target_log_return(w)}).na.drop("any")


def next_features(history: DataFrame, new_bars: DataFrame, n: int = 20, macro: DataFrame | None = None, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """The last n feature rows of every key after a new bar: the input of a forecast. Macro values come with the bars, or from macro."""
    bars = append_bar(history, new_bars, keys, order)
    bars = merge_macro(bars, macro, keys=keys, order=order) if macro is not None else bars
    return tail_n(compute_features(bars, keys, order), n, keys, order)


def since(bars: DataFrame, start, warmup: int = 700, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Bars from start on, and of the keys that have such, the warm-up rows before that features need (EWM tails included).

    A first pass reads keys and times alone and counts rows by month; the month that all warm-up rows lie in or after then
    bounds the scan of the other columns.
    """
    now = bars.where(F.col(order) >= start)
    months = bars.where(F.col(order) < start).groupBy(*keys, F.date_trunc("month", F.col(order)).cast("timestamp_ntz").alias("_month")).agg(F.count("*").alias("_c"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_month")).rowsBetween(Window.unboundedPreceding, -1)
    months = months.join(now.select(*keys).distinct(), list(keys), "left_semi").withColumn("_after", F.coalesce(F.sum("_c").over(later), F.lit(0)))
    bound = months.where(F.col("_after") < warmup).agg(F.min("_month")).first()[0]
    if bound is None:
        return now
    early = bars.where((F.col(order) >= F.lit(bound).cast(bars.schema[order].dataType)) & (F.col(order) < start))
    early = early.withColumn("_back", F.row_number().over(series(keys, F.desc(order)))).where(F.col("_back") <= warmup).drop("_back")
    return now.unionByName(early.join(now.select(*keys).distinct(), list(keys), "left_semi"))
