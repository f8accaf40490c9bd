"""The registered queries, each beside its SQL. Derived doubles are rounded to six digits on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import features as fe
from tideline.functions import windows as win
from tideline.operators import align, boosting, forecast, metrics, models, protocol, sequence_net, stats
from tideline.operators.boosting import Params
from tideline.plans.tables import SQL_MACRO, SQL_PRED, bars_daily, bars_hourly, macro_daily, macro_long, predictions, sql_bars
from tideline.schema import FEATURE_COLUMNS, LAG_COLUMNS, inputs
from tideline.sources import bars as src
from tideline.sources import tables
from tideline.streaming.streams import stream_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
W = "WINDOW s AS (PARTITION BY symbol ORDER BY ts)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    return align.round_all(df, 6)


def rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    """A rolling aggregate that needs its whole window."""
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {f}({x}) OVER {rows(n)} END"


def num(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


BARS = sql_bars()
RET = "ret AS (SELECT *, ln(close / lag(close) OVER s) AS log_return, (high - low) / nullif(open, 0) AS bar_dynamics FROM bars " + W + ")"


@query(f"WITH {BARS} SELECT * FROM bars")
def bars_daily_ohlcv(spark, d):
    return bars_daily(spark, d)


@query("SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS tick_volume FROM events WHERE value IS NOT NULL GROUP BY ALL")
def bars_hourly_ohlcv(spark, d):
    return bars_hourly(spark, d)


@query(f"WITH {BARS} SELECT symbol, ts, {num('ln(close / lag(close) OVER s)', 'log_return')}, " + ", ".join([num(roll("avg", "close", n), f"SMA_{n}") for n in (21, 50, 100, 200)] + [num(div("close - " + roll("avg", "close", n), roll("avg", "close", n)), f"dist_SMA_{n}") for n in (21, 50, 100, 200)]) + f" FROM bars {W}")
def trend_features(spark, d):
    w = win.series()
    cols = {"log_return": fe.log_return(w), **{f"SMA_{n}": fe.sma(n, w) for n in (21, 50, 100, 200)}, **{f"dist_SMA_{n}": fe.dist_sma(n, w) for n in (21, 50, 100, 200)}}
    return r6(bars_daily(spark, d).withColumns(cols).select("symbol", "ts", *cols))


_STD20, _AVG20 = roll("stddev_samp", "close", 20), roll("avg", "close", 20)


@query(f"WITH {BARS}, {RET} SELECT symbol, ts, " + ", ".join([num(roll("stddev_samp", "log_return", n), f"volatility_{n}") for n in (5, 20)] + [num(roll("avg", "log_return", n), f"return_mean_{n}") for n in (5, 10)] + [num(roll("stddev_samp", "log_return", n), f"return_std_{n}") for n in (5, 10)] + [num(div(f"4 * {_STD20}", _AVG20), "BB_width"), num(div(f"close - {_AVG20} + 2 * {_STD20}", f"4 * {_STD20}"), "BB_pct_b")]) + " FROM ret")
def volatility_features(spark, d):
    w = win.series()
    df = bars_daily(spark, d).withColumn("log_return", fe.log_return(w))
    r = F.col("log_return")
    cols = {**{f"volatility_{n}": fe.volatility(n, w) for n in (5, 20)}, **{f"return_mean_{n}": win.rolling_mean(r, n, w) for n in (5, 10)}, **{f"return_std_{n}": win.rolling_std(r, n, w) for n in (5, 10)}, "BB_width": fe.bb_width(20, 2, w), "BB_pct_b": fe.bb_pct_b(20, 2, w)}
    return r6(df.withColumns(cols).select("symbol", "ts", *cols))


_DAY = "((dayofweek(ts) + 6) % 7)"


@query(f"WITH {BARS}, {RET} SELECT symbol, ts, round(bar_dynamics, 6) AS bar_dynamics, " + ", ".join([num(f"lag({x}, {k}) OVER s", f"{p}_{k}") for x, p, ks in (("log_return", "return_lag", (1, 2, 3, 4, 5)), ("bar_dynamics", "dynamics_lag", (1, 2, 3))) for k in ks]) + f", {num(f'sin({_DAY} * 2 * pi() / 7)', 'sin7')}, {num(f'cos({_DAY} * 2 * pi() / 7)', 'cos7')}, {num(f'sin({_DAY} * 2 * pi() / 5)', 'sin5')}, {num(f'cos({_DAY} * 2 * pi() / 5)', 'cos5')}, {num('sin(month(ts) * 2 * pi() / 12)', 'sin12')}, {num('cos(month(ts) * 2 * pi() / 12)', 'cos12')}, {_DAY}::INT AS day_of_week, hour(ts)::INT AS hour_of_day FROM ret {W}")
def lag_calendar_features(spark, d):
    w = win.series()
    df = bars_daily(spark, d).withColumns({"log_return": fe.log_return(w), "bar_dynamics": fe.bar_dynamics()})
    s7, c7, s5, c5, s12, c12 = (*fe.cyclic("weekday", 7), *fe.cyclic("weekday", 5), *fe.cyclic("month", 12))
    cols = {**fe.lags("log_return", "return_lag", range(1, 6), w), **fe.lags("bar_dynamics", "dynamics_lag", (1, 2, 3), w), "sin7": s7, "cos7": c7, "sin5": s5, "cos5": c5, "sin12": s12, "cos12": c12, "day_of_week": F.weekday("ts"), "hour_of_day": F.hour("ts")}
    return r6(df.withColumns(cols).select("symbol", "ts", "bar_dynamics", *cols))


_LO, _HI = roll("min", "low", 14), roll("max", "high", 14)


@query(f"WITH {BARS}, k AS (SELECT *, 100 * {div(f'close - {_LO}', f'{_HI} - {_LO}')} AS k, -100 * {div(f'{_HI} - close', f'{_HI} - {_LO}')} AS wr, 100 * (close / nullif(lag(close, 10) OVER s, 0) - 1) AS roc FROM bars {W}) SELECT symbol, ts, round(k, 6) AS Stoch_K, {num(roll('avg', 'k', 3), 'Stoch_D')}, round(wr, 6) AS Williams_R, round(roc, 6) AS ROC_10 FROM k")
def oscillators(spark, d):
    w = win.series()
    df = bars_daily(spark, d).withColumns({"Stoch_K": fe.stochastic(14, w), "Williams_R": fe.williams_r(14, w), "ROC_10": fe.roc(10, w)})
    return r6(df.withColumn("Stoch_D", win.rolling_mean(F.col("Stoch_K"), 3, w)).select("symbol", "ts", "Stoch_K", "Stoch_D", "Williams_R", "ROC_10"))


def ewm_sql(bars: str) -> str:
    return f"""RECURSIVE {bars},
num AS (SELECT *, row_number() OVER s AS i, close - lag(close) OVER s AS move,
  greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr FROM bars {W}),
e AS (
  SELECT symbol, i, tr AS atr, close AS f, close AS w, NULL::DOUBLE AS g, NULL::DOUBLE AS l, 0.0::DOUBLE AS sig FROM num WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.i, e.atr * 13 / 14 + n.tr / 14, e.f * 11 / 13 + n.close * 2 / 13, e.w * 25 / 27 + n.close * 2 / 27,
    coalesce(e.g * 13 / 14 + greatest(n.move, 0) / 14, greatest(n.move, 0)), coalesce(e.l * 13 / 14 + greatest(-n.move, 0) / 14, greatest(-n.move, 0)),
    e.sig * 0.8 + 0.2 * ((e.f * 11 / 13 + n.close * 2 / 13) - (e.w * 25 / 27 + n.close * 2 / 27))
  FROM e JOIN num n ON n.symbol = e.symbol AND n.i = e.i + 1),
ewm AS (SELECT n.*, e.atr, e.f - e.w AS macd, e.sig, e.g, e.l FROM num n JOIN e ON n.symbol = e.symbol AND n.i = e.i)"""


EWM = ewm_sql(BARS)


@query(f"WITH {EWM} SELECT symbol, ts, round(atr, 3) AS ATR_14, round(100 - 100 / nullif(1 + g / nullif(l, 0), 0), 6) AS RSI_14, round(macd, 3) AS MACD, round(sig, 3) AS MACD_signal, round(macd - sig, 3) AS MACD_hist FROM ewm")
def atr_rsi_macd(spark, d):
    out = fe.with_macd(fe.with_rsi(fe.with_atr(bars_daily(spark, d))))
    return out.select("symbol", "ts", F.round("RSI_14", 6).alias("RSI_14"), *[F.round(c, 3).alias(c) for c in ("ATR_14", "MACD", "MACD_signal", "MACD_hist")])


def fs1_sql(bars: str) -> str:
    return f"""{ewm_sql(bars).replace("RECURSIVE ", f"RECURSIVE {SQL_MACRO}, ", 1)}, base AS (SELECT *, ln(close / lag(close) OVER s) AS log_return, (high - low) / nullif(open, 0) AS bar_dynamics FROM ewm {W}),
merged AS (SELECT b.*, last_value(u.v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b.ts) AS yield_differential FROM base b LEFT JOIN urgent u ON b.ts = u.ts),
fs AS (SELECT symbol, ts, open, high, low, close, {num('log_return', 'log_return')}, {', '.join(num(roll('avg', 'close', n), f'SMA_{n}') for n in (21, 50, 100, 200))}, {num(roll('stddev_samp', 'log_return', 20), 'volatility_20')},
  {num('bar_dynamics', 'bar_dynamics')}, {', '.join(num(f'lag({x}, {k}) OVER s', f'{p}_{k}') for k in (1, 2, 3) for x, p in (('log_return', 'return_lag'), ('bar_dynamics', 'dynamics_lag')))},
  {num(f'sin({_DAY} * 2 * pi() / 7)', 'day_sin')}, {num(f'cos({_DAY} * 2 * pi() / 7)', 'day_cos')}, {num('sin(month(ts) * 2 * pi() / 12)', 'month_sin')}, {num('cos(month(ts) * 2 * pi() / 12)', 'month_cos')},
  round(atr, 3) AS ATR_14, {num(div(f'4 * {_STD20}', _AVG20), 'BB_width')}, {num('yield_differential', 'yield_differential')}, tick_volume,
  {num('(lead(close) OVER s - close) / close * 100', 'target_return')} FROM merged {W})"""


_FS1 = fs1_sql(BARS)


def _with_macro(spark, d) -> DataFrame:
    return align.merge_macro(bars_daily(spark, d), macro_daily(spark, d))


@query(f"WITH {_FS1} SELECT * EXCLUDE (target_return) FROM fs")
def feature_contract(spark, d):
    return r6(fe.compute_features(_with_macro(spark, d)).withColumn("ATR_14", F.round("ATR_14", 3)))


@query(f"WITH {_FS1} SELECT *, (target_return > 0)::INT AS target_direction FROM fs WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*FEATURE_COLUMNS, 'tick_volume', 'target_return'))}")
def training_matrix(spark, d):
    out = r6(fe.training_features(_with_macro(spark, d)).drop("target_direction").withColumn("ATR_14", F.round("ATR_14", 3)))
    return out.withColumn("target_direction", fe.target_direction(F.col("target_return")))


@query(f"WITH {BARS}, {RET} SELECT symbol, ts, {num('(lead(close) OVER s - close) / nullif(close, 0) * 100', 'ret')}, (lead(close) OVER s > close)::INT AS direction, coalesce((lead(close) OVER s > close)::INT, 0) AS updown_zero, {num('lead(log_return) OVER s', 'log_ret')} FROM ret {W}")
def targets_variants(spark, d):
    w = win.series()
    df = bars_daily(spark, d).withColumn("log_return", fe.log_return(w)).withColumn("ret", fe.target_return(w))
    return r6(df.select("symbol", "ts", "ret", fe.target_direction(F.col("ret")).alias("direction"), fe.target_updown(w, "zero").alias("updown_zero"), fe.target_log_return(w).alias("log_ret")))


def some(columns: dict[str, str], source: str, digits: dict[str, int] | None = None) -> str:
    """SQL for the rows whose columns are all there, rounded."""
    rounded = ", ".join(f"round({c}, {(digits or {}).get(c, 6)}) AS {c}" if kind == "n" else c for c, kind in columns.items())
    return f"SELECT {rounded} FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}"


_ROW = {"symbol": "", "ts": "", "open": "", "high": "", "low": "", "close": "", "tick_volume": ""}
_UP = "(lead(close) OVER s > close)::INT AS target"
_SMAS = ", ".join(f"{roll('avg', 'close', n)} AS SMA_{n}" for n in (21, 50, 100, 200))
_BASIC = {**_ROW, **dict.fromkeys(["log_return", "bar_dynamics", "SMA_21", "SMA_50", "SMA_100", "SMA_200", "day_sin", "day_cos", "volatility_20", *[f"{p}_{k}" for k in (1, 2, 3) for p in ("return_lag", "dynamics_lag")]], "n"), "target": ""}
_EDA = {**_ROW, **dict.fromkeys(["log_return", "bar_dynamics", "day_sin", "day_cos", *[f"lag_{k}" for k in range(1, 6)], "bar_dynamics_lag_1", "target_return"], "n"), "day_of_week": ""}
_RICH = {**_ROW, **dict.fromkeys(["log_return", *[f"{p}SMA_{n}" for n in (21, 50, 100, 200) for p in ("", "dist_")], "BB_bandwidth", "BB_pct_b", "Stoch_K", "Stoch_D", "Williams_R", "ROC_10", "volatility_20", "volatility_5", *[f"lag_{k}" for k in range(1, 6)], *[f"return_{x}_{n}" for x in ("mean", "std") for n in (5, 10)], "ATR_14", "RSI_14", "MACD", "MACD_signal", "MACD_hist"], "n"), "hour_of_day": "", "day_of_week": "", "target": ""}
_COARSE = {"ATR_14": 3, "MACD": 3, "MACD_signal": 3, "MACD_hist": 3}


def coarse(df: DataFrame) -> DataFrame:
    """Columns of the scale of prices to three digits, as sums of them in another order differ beyond that."""
    return r6(df.withColumns({c: F.round(c, k) for c, k in _COARSE.items() if c in df.columns}))


@query(f"WITH {BARS}, {RET}, f AS (SELECT *, {_SMAS}, sin({_DAY} * 2 * pi() / 7) AS day_sin, cos({_DAY} * 2 * pi() / 7) AS day_cos, {_UP}, {roll('stddev_samp', 'log_return', 20)} AS volatility_20, {', '.join(f'lag({x}, {k}) OVER s AS {p}_{k}' for k in (1, 2, 3) for x, p in (('log_return', 'return_lag'), ('bar_dynamics', 'dynamics_lag')))} FROM ret {W}) {some(_BASIC, 'f')}")
def basic_set(spark, d):
    return r6(fe.basic_features(bars_daily(spark, d)))


@query(f"WITH {ewm_sql(BARS)}, r AS (SELECT *, ln(close / lag(close) OVER s) AS log_return, 100 * {div(f'close - {_LO}', f'{_HI} - {_LO}')} AS Stoch_K FROM ewm {W}), f AS (SELECT *, {_SMAS}, {', '.join(div('close - ' + roll('avg', 'close', n), roll('avg', 'close', n)) + f' AS dist_SMA_{n}' for n in (21, 50, 100, 200))}, {div(f'4 * {_STD20}', _AVG20)} AS BB_bandwidth, {div(f'close - {_AVG20} + 2 * {_STD20}', f'4 * {_STD20}')} AS BB_pct_b, {roll('avg', 'Stoch_K', 3)} AS Stoch_D, -100 * {div(f'{_HI} - close', f'{_HI} - {_LO}')} AS Williams_R, 100 * (close / nullif(lag(close, 10) OVER s, 0) - 1) AS ROC_10, {roll('stddev_samp', 'log_return', 20)} AS volatility_20, {roll('stddev_samp', 'log_return', 5)} AS volatility_5, {', '.join(f'lag(log_return, {k}) OVER s AS lag_{k}' for k in range(1, 6))}, {', '.join(roll(f, 'log_return', n) + f' AS return_{x}_{n}' for x, f in (('mean', 'avg'), ('std', 'stddev_samp')) for n in (5, 10))}, hour(ts)::INT AS hour_of_day, {_DAY}::INT AS day_of_week, {_UP}, atr AS ATR_14, 100 - 100 / nullif(1 + g / nullif(l, 0), 0) AS RSI_14, sig AS MACD_signal, macd - sig AS MACD_hist FROM r {W}) {some(_RICH, 'f', _COARSE)}")
def indicator_set(spark, d):
    return coarse(fe.indicator_features(bars_daily(spark, d)))


@query(f"WITH {BARS}, {RET}, f AS (SELECT *, {_DAY}::INT AS day_of_week, sin({_DAY} * 2 * pi() / 5) AS day_sin, cos({_DAY} * 2 * pi() / 5) AS day_cos, {', '.join(f'lag(log_return, {k}) OVER s AS lag_{k}' for k in range(1, 6))}, lag(bar_dynamics) OVER s AS bar_dynamics_lag_1, lead(log_return) OVER s AS target_return FROM ret {W}) {some(_EDA, 'f')}")
def eda_set(spark, d):
    return r6(fe.eda_features(bars_daily(spark, d)))


@query(f"WITH {SQL_MACRO}, a AS (SELECT coalesce(u.ts, m.ts) AS ts, u.v AS us, m.v AS de FROM urgent u FULL JOIN slow m ON u.ts = m.ts), f AS (SELECT ts, last_value(us IGNORE NULLS) OVER o AS us10y, last_value(de IGNORE NULLS) OVER o AS de10y FROM a WINDOW o AS (ORDER BY ts)) SELECT ts, round(us10y, 6) AS us10y, round(de10y, 6) AS de10y, round(us10y - de10y, 6) AS yield_differential FROM f WHERE us10y IS NOT NULL AND de10y IS NOT NULL")
def macro_spread(spark, d):
    return r6(align.align_spread(macro_long(spark, d)))


@query(f"WITH {BARS}, {SQL_MACRO} SELECT b.*, round(last_value(u.v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b.ts), 6) AS yield_differential FROM bars b LEFT JOIN urgent u ON b.ts = u.ts")
def macro_merge(spark, d):
    return r6(_with_macro(spark, d))


@query(f"WITH {BARS}, {SQL_MACRO} SELECT b.*, round(u.v, 6) AS yield_differential FROM bars b ASOF LEFT JOIN urgent u ON b.ts >= u.ts")
def macro_asof(spark, d):
    return r6(align.merge_macro(bars_daily(spark, d), macro_daily(spark, d), mode="asof"))


@query(f"WITH {BARS}, {SQL_MACRO} SELECT symbol, round(corr(close, v), 6) AS level_corr, count(*) AS n FROM bars b JOIN urgent u ON b.ts = u.ts GROUP BY symbol")
def level_corr(spark, d):
    both = align.inner_aligned(bars_daily(spark, d), macro_daily(spark, d), ["ts"])
    return r6(both.groupBy("symbol").agg(F.corr("close", "yield_differential").alias("level_corr"), F.count("*").alias("n")))


def _live(spark, d) -> DataFrame:
    return bars_daily(spark, d).where("symbol <> 'N' and ts >= timestamp_ntz'1996-01-01'")


@query(f"WITH {BARS}, live AS (SELECT * FROM bars WHERE symbol <> 'N' AND ts >= TIMESTAMP '1996-01-01') SELECT *, 'live' AS data_source FROM live UNION ALL SELECT *, 'history' FROM bars WHERE symbol NOT IN (SELECT symbol FROM live)")
def source_fallback(spark, d):
    return src.first_nonempty([("live", _live(spark, d)), ("history", bars_daily(spark, d))])


@query(f"WITH {BARS}, live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars WHERE symbol <> 'N') WHERE k <= CASE symbol WHEN 'A' THEN 100 ELSE 300 END), f AS (SELECT symbol, min(ts) AS f, count(*) AS have FROM live GROUP BY symbol), old AS (SELECT b.*, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts DESC) AS k, coalesce(have, 0) AS have FROM bars b LEFT JOIN f USING (symbol) WHERE f.f IS NULL OR b.ts < f.f) SELECT symbol, ts, open, high, low, close, tick_volume, CASE symbol WHEN 'A' THEN 'live+history_backfill' WHEN 'N' THEN 'history' ELSE 'live' END AS data_source FROM (SELECT symbol, ts, open, high, low, close, tick_volume FROM live UNION ALL SELECT symbol, ts, open, high, low, close, tick_volume FROM old WHERE k <= 250 - have)")
def history_backfill(spark, d):
    bars = bars_daily(spark, d)
    live = src.tail_n(bars.where("symbol <> 'N'"), F.when(F.col("symbol") == "A", 100).otherwise(300))
    return src.backfill(live, bars, src.bars_needed())


@query(f"WITH {BARS} SELECT symbol, ts, open, high, low, CASE WHEN ts >= TIMESTAMP '1997-01-01' THEN close + 1 ELSE close END AS close, tick_volume FROM bars")
def precedence_union(spark, d):
    bars = bars_daily(spark, d)
    newer = bars.where("ts >= timestamp_ntz'1997-01-01'").withColumn("close", F.col("close") + 1)
    return src.union_precedence([bars, newer], ["symbol", "ts"])


@query(f"WITH {BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def latest_bars(spark, d):
    return src.latest_bar(bars_daily(spark, d))


@query(f"WITH {BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def tail_20(spark, d):
    return src.tail_n(bars_daily(spark, d), 20)


@query(f"WITH {BARS} SELECT * FROM bars UNION ALL SELECT symbol, ts + INTERVAL 1 DAY, open, high, low, close, tick_volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1".replace("SELECT * FROM bars UNION", "SELECT * FROM bars b0 UNION").replace("SELECT symbol, ts + INTERVAL 1 DAY, open, high, low, close, tick_volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", "SELECT symbol, max(ts) + INTERVAL 1 DAY, arg_max(open, ts), arg_max(high, ts), arg_max(low, ts), arg_max(close, ts), arg_max(tick_volume, ts) FROM bars GROUP BY symbol"))
def append_next_bar(spark, d):
    bars = bars_daily(spark, d)
    return src.append_bar(bars, src.latest_bar(bars))


_NEXT = sql_bars("known") + ", bars AS (SELECT * FROM known UNION ALL SELECT symbol, max(ts) + INTERVAL 1 DAY, arg_max(open, ts), arg_max(high, ts), arg_max(low, ts), arg_max(close, ts), arg_max(tick_volume, ts) FROM known GROUP BY symbol)"


@query(f"WITH {fs1_sql(_NEXT)} SELECT * EXCLUDE (target_return) FROM fs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def next_bar_features(spark, d):
    bars = bars_daily(spark, d)
    return coarse(fe.next_features(bars, src.latest_bar(bars), 20, macro_daily(spark, d)))


@query(f"WITH {BARS}, {RET}, f AS (SELECT symbol, ts, {num('log_return', 'log_return')}, {num(roll('avg', 'close', 200), 'SMA_200')}, {num(roll('stddev_samp', 'log_return', 20), 'volatility_20')} FROM ret) SELECT * FROM f WHERE ts >= TIMESTAMP '1997-01-01'")
def features_since(spark, d):
    """Features of late bars alone; of earlier bars only the warm-up is read."""
    bars = fe.since(bars_daily(spark, d), F.lit("1997-01-01").cast("timestamp_ntz")).withColumn("yield_differential", F.lit(0.0))
    return r6(fe.compute_features(bars).where("ts >= timestamp_ntz'1997-01-01'").select("symbol", "ts", "log_return", "SMA_200", "volatility_20"))


@query(f"WITH {BARS}, {SQL_MACRO} SELECT symbol, round(count(u.v) / count(*)::DOUBLE, 6) AS coverage FROM bars b LEFT JOIN urgent u ON b.ts = u.ts GROUP BY symbol")
def macro_coverage(spark, d):
    return r6(align.coverage(bars_daily(spark, d).join(macro_daily(spark, d), "ts", "left"), "yield_differential"))


@query("SELECT symbol, n AS rows, CASE WHEN n < 500 THEN 'fewer than 500 usable rows' END AS reason FROM (SELECT event_type AS symbol, count(DISTINCT date_trunc('hour', ts)) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)")
def required_rows(spark, d):
    bars = bars_hourly(spark, d)
    ok, rejected = align.require_rows(bars, 500)
    return ok.groupBy("symbol").agg(F.count("*").alias("rows")).withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query(f"WITH {BARS} SELECT DISTINCT ts::DATE AS day, (ts::DATE + CASE dayofweek(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT)::DATE AS next_day FROM bars")
def next_session(spark, d):
    return bars_daily(spark, d).select(F.to_date("ts").alias("day")).distinct().withColumn("next_day", forecast.next_session(F.col("day")))


def _members(spark, d) -> DataFrame:
    p = predictions(spark, d).withColumn("as_of_date", F.to_date("ts"))
    return forecast.score_member(p, "a", F.col("p_a"), F.col("ret_a"), order=0).unionByName(forecast.score_member(p, "b", F.col("p_b"), F.col("ret_b"), order=1))


_CONS = f"""{SQL_PRED}, m AS (SELECT symbol, ts::DATE AS as_of_date, close, CASE WHEN p_a >= 0.5 THEN 'UP' ELSE 'DOWN' END AS da, CASE WHEN p_b >= 0.5 THEN 'UP' ELSE 'DOWN' END AS db,
  CASE WHEN p_a >= 0.5 THEN p_a ELSE 1 - p_a END AS ca, CASE WHEN p_b >= 0.5 THEN p_b ELSE 1 - p_b END AS cb, ret_a, ret_b FROM pred),
c AS (SELECT symbol, as_of_date, close, CASE WHEN da = db AND (ca + cb) / 2 < 0.52 THEN 'MIXED / LOW CONFIDENCE' WHEN ca >= cb THEN da ELSE db END AS direction,
  da = db AND (ca + cb) / 2 >= 0.52 AS agreement, round(CASE WHEN da = db THEN (ca + cb) / 2 WHEN ca >= cb THEN ca ELSE cb END, 6) AS confidence,
  round(CASE WHEN da = db THEN (ret_a + ret_b) / 2 WHEN ca >= cb THEN ret_a ELSE ret_b END, 6) AS predicted_return_pct FROM m)"""


@query(f"WITH {_CONS} SELECT * EXCLUDE (close) FROM c")
def consensus(spark, d):
    return r6(forecast.consensus(_members(spark, d)).drop("models"))


def _ledger(spark, d) -> DataFrame:
    return forecast.to_ledger(forecast.forecast(bars_daily(spark, d), forecast.consensus(_members(spark, d))))


_SCORED = f"""{_CONS}, l AS (SELECT *, (as_of_date + CASE dayofweek(as_of_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT)::DATE AS forecasting_date FROM c),
sc AS (SELECT l.*, b.close AS actual_close, (b.close - l.close) / l.close * 100 AS ret FROM l LEFT JOIN bars b ON l.symbol = b.symbol AND b.ts::DATE = l.forecasting_date),
o AS (SELECT symbol, as_of_date, forecasting_date, direction AS pred_direction, actual_close, round(ret, 6) AS actual_return_pct,
  CASE WHEN ret IS NULL THEN 'pending' WHEN starts_with(direction, CASE WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END) THEN 'correct' ELSE 'wrong' END AS outcome FROM sc)"""


@query(f"WITH {_SCORED} SELECT * FROM o")
def forecast_scoring(spark, d):
    out = forecast.score_ledger(_ledger(spark, d), bars_daily(spark, d))
    return r6(out.select("symbol", "as_of_date", "forecasting_date", "pred_direction", "actual_close", "actual_return_pct", "outcome"))


@query(f"WITH {_SCORED} SELECT symbol, count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome <> 'pending') AS n_resolved, round(count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome <> 'pending'), 0)::DOUBLE, 6) AS hit_rate FROM o GROUP BY symbol")
def hit_rate(spark, d):
    return r6(forecast.hit_rate(forecast.score_ledger(_ledger(spark, d), bars_daily(spark, d))))


@query(f"WITH {_CONS} SELECT symbol, as_of_date, CASE WHEN as_of_date >= DATE '1998-01-01' THEN 'UP' ELSE direction END AS pred_direction FROM c")
def ledger_upsert(spark, d):
    log = _ledger(spark, d).select("symbol", "as_of_date", "pred_direction")
    return tables.upsert(log, log.where("as_of_date >= date'1998-01-01'").withColumn("pred_direction", F.lit("UP")))


@query(f"WITH {_CONS}, f AS (SELECT c.*, b.open, b.high, b.low, b.close AS last, b.tick_volume FROM c JOIN bars b ON b.symbol = c.symbol AND b.ts::DATE = c.as_of_date) SELECT symbol, as_of_date, (as_of_date + CASE dayofweek(as_of_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT)::DATE::VARCHAR AS forecasting_date, 'live' AS data_source, 'table' AS macro_source, open, last AS close, direction, agreement, confidence, predicted_return_pct FROM f")
def forecast_documents(spark, d):
    """The documents, and from each what a reader of its JSON gets back."""
    docs = forecast.to_document(forecast.forecast(bars_daily(spark, d), forecast.consensus(_members(spark, d))))
    kind = "forecasting_date string, data_source string, macro_source string, bar_used struct<open:double,close:double>, consensus struct<direction:string,agreement:boolean,confidence:double,predicted_return_pct:double>"
    back = docs.select("symbol", "as_of_date", F.from_json("document", kind).alias("x"))
    return r6(back.select("symbol", "as_of_date", "x.forecasting_date", "x.data_source", "x.macro_source", "x.bar_used.*", "x.consensus.*"))


def percent_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' ELSE printf('%+.4f%%', {c}) END"


@query(f"WITH {_SCORED} SELECT o.symbol, o.as_of_date, o.forecasting_date, pred_direction, {percent_sql('predicted_return_pct')} AS predicted, printf('%.1f%%', confidence * 100) AS confidence, {percent_sql('ret')} AS actual, outcome FROM o JOIN (SELECT symbol, as_of_date, confidence, predicted_return_pct, ret FROM sc) USING (symbol, as_of_date)")
def forecast_display(spark, d):
    return forecast.display_columns(forecast.score_ledger(_ledger(spark, d), bars_daily(spark, d)))


_LAST = sql_bars("known") + ", bars AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 250)"


@query(f"WITH {fs1_sql(_LAST)} SELECT * EXCLUDE (target_return), 'live+history_backfill' AS data_source FROM fs WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_COLUMNS)} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def resolved_window(spark, d):
    bars = bars_daily(spark, d)
    return coarse(forecast.resolve_window(src.tail_n(bars, 100), bars, macro_daily(spark, d), src.bars_needed())[0])


_POS = f"{BARS}, p AS (SELECT *, row_number() OVER s AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars {W})"
_SPLIT = "CASE WHEN pos > floor(n * 0.8::DOUBLE) THEN 'test' WHEN pos > floor(n * (0.8::DOUBLE - 0.1::DOUBLE)) THEN 'val' ELSE 'train' END"


@query(f"WITH {_POS} SELECT symbol, ts, {_SPLIT} AS block FROM p")
def chrono_split(spark, d):
    return protocol.chrono_split(bars_daily(spark, d).select("symbol", "ts"))


@query(f"WITH {_POS}, k AS (SELECT *, n // 6 AS size, unnest(range(1, 6)) AS fold FROM p) SELECT symbol, ts, fold::INT AS fold, CASE WHEN pos > n - (6 - fold) * size THEN 'test' ELSE 'train' END AS part FROM k WHERE pos <= n - (6 - fold) * size + size")
def expanding_folds(spark, d):
    return protocol.expanding_folds(bars_daily(spark, d).select("symbol", "ts"))


@query(f"WITH {_POS}, b AS (SELECT *, {_SPLIT} AS block FROM p), q AS (SELECT *, row_number() OVER z AS i, count(*) OVER (PARTITION BY symbol, block) AS m, sum(close) OVER (z ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM b WINDOW z AS (PARTITION BY symbol, block ORDER BY ts)) SELECT symbol, block, ts, round(c, 4) AS close_sum FROM q WHERE i >= 20 AND i < m")
def sequence_windows(spark, d):
    out = protocol.sequences(protocol.chrono_split(bars_daily(spark, d)), ["open", "close"], 20)
    return out.select("symbol", "block", "ts", F.round(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[1]), 4).alias("close_sum"))


@query(f"WITH {_POS}, b AS (SELECT *, {_SPLIT} AS block FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY symbol, block ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol, block) AS m FROM b) SELECT e.symbol, e.block, e.ts, (s.i - e.i + 19)::INT AS step, round(s.open, 6) AS open, round(s.close, 6) AS close FROM q e JOIN q s ON e.symbol = s.symbol AND e.block = s.block AND s.i BETWEEN e.i - 19 AND e.i WHERE e.i >= 20 AND e.i < e.m")
def sequence_cells(spark, d):
    """Every cell of the windows."""
    out = protocol.sequences(protocol.chrono_split(bars_daily(spark, d)), ["open", "close"], 20)
    cells = out.select("symbol", "block", "ts", F.posexplode("seq").alias("step", "x"))
    return r6(cells.select("symbol", "block", "ts", "step", F.col("x")[0].alias("open"), F.col("x")[1].alias("close")))


@query(f"WITH {_POS}, b AS (SELECT *, {_SPLIT} AS block FROM p), m AS (SELECT avg(close) AS m, stddev_pop(close) AS s FROM b WHERE block <> 'test') SELECT symbol, ts, round((close - m) / s, 6) AS close FROM b, m")
def train_only_scaling(spark, d):
    df = protocol.chrono_split(bars_daily(spark, d).select("symbol", "ts", "close"))
    return r6(protocol.apply_scaler(df, protocol.fit_scaler(df.where("block <> 'test'"), ["close"])).drop("block"))


@query(f"WITH {BARS}, {RET}, dm AS (SELECT symbol, ts, log_return - avg(log_return) OVER (PARTITION BY symbol) AS d FROM ret WHERE log_return IS NOT NULL), l AS (SELECT symbol, d, k.lag, lag(d, k.lag::INT) OVER (PARTITION BY symbol, k.lag ORDER BY ts) AS e FROM dm, range(21) k(lag)) SELECT symbol, lag::INT AS lag, round(sum(d * e) / max(s), 6) AS acf, round(max(1.96 / sqrt(n)), 6) AS band FROM l JOIN (SELECT symbol, sum(d * d) AS s, count(*) AS n FROM dm GROUP BY symbol) USING (symbol) GROUP BY symbol, lag")
def acf20(spark, d):
    return r6(stats.acf(bars_daily(spark, d).withColumn("log_return", fe.log_return(win.series())), "log_return"))


@query(f"WITH {BARS} SELECT symbol, 'close' AS \"column\", count(close) AS count, round(avg(close), 6) AS mean, round(stddev_samp(close), 6) AS std, round(min(close), 6) AS min, round(quantile_cont(close, 0.25), 6) AS q25, round(quantile_cont(close, 0.5), 6) AS q50, round(quantile_cont(close, 0.75), 6) AS q75, round(max(close), 6) AS max FROM bars GROUP BY symbol")
def describe(spark, d):
    return r6(stats.describe(bars_daily(spark, d), ["close"]))


@query(f"WITH {SQL_PRED} SELECT symbol, label, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM pred GROUP BY symbol, label")
def value_counts(spark, d):
    return r6(stats.value_counts(predictions(spark, d), "label"))


@query(f"WITH {BARS} SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM bars GROUP BY symbol")
def time_range(spark, d):
    return stats.time_range(bars_daily(spark, d))


_RES = f"{SQL_PRED}, res AS (SELECT symbol, ts, y_ret - ret_a AS x FROM pred), mm AS (SELECT symbol, avg(x) AS m FROM res GROUP BY symbol)"


@query(f"WITH {_RES} SELECT symbol, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 6) AS skew, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 6) AS kurtosis FROM res JOIN mm USING (symbol) GROUP BY symbol")
def residual_stats(spark, d):
    return r6(stats.moments(stats.residuals(predictions(spark, d), "y_ret", "ret_a"), "residual"))


@query(f"WITH {BARS}, e AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol) SELECT symbol, least(floor((close - lo) * 40 / (hi - lo)) + 1, 40)::INT AS bin, count(*) AS count FROM bars JOIN e USING (symbol) GROUP BY ALL")
def histogram40(spark, d):
    return stats.histogram(bars_daily(spark, d), "close", 40)


@query(f"WITH {SQL_PRED}, c AS (SELECT symbol, avg((label = pred)::INT) AS acc, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (pred = 1) AS pp, count(*) FILTER (label = 1) AS rp FROM pred GROUP BY symbol) SELECT symbol, round(acc, 6) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(rp, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + rp, 0), 0), 6) AS f1 FROM c")
def clf_metrics(spark, d):
    p = predictions(spark, d)
    return r6(metrics.accuracy(p, "label", "pred").join(metrics.prf(p, "label", "pred"), "symbol"))


@query(f"WITH {SQL_PRED}, k AS (SELECT symbol, label, rank() OVER (PARTITION BY symbol ORDER BY p_a) + (count(*) OVER (PARTITION BY symbol, p_a) - 1) / 2 AS r FROM pred) SELECT symbol, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS roc_auc FROM k GROUP BY symbol")
def roc_auc(spark, d):
    return r6(metrics.roc_auc(predictions(spark, d), "label", "p_a"))


@query(f"WITH {SQL_PRED} SELECT symbol, label, pred AS prediction, count(*) AS count FROM pred GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d), "label", "pred")


@query(f"WITH {SQL_PRED}, k AS (SELECT p.symbol, c.c, count(*) FILTER (label = c.c AND pred = c.c) AS tp, count(*) FILTER (pred = c.c) AS pp, count(*) FILTER (label = c.c) AS support FROM pred p, (VALUES (0), (1)) c(c) GROUP BY ALL), r AS (SELECT symbol, c::VARCHAR AS class, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pp + support, 0), 0) AS f1, support FROM k), a AS (SELECT * FROM r UNION ALL SELECT symbol, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM r GROUP BY symbol UNION ALL SELECT symbol, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM r GROUP BY symbol) SELECT symbol, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM a")
def class_report(spark, d):
    return r6(metrics.class_report(predictions(spark, d), "label", "pred"))


@query(f"WITH {SQL_PRED} SELECT symbol, round(avg(pow(y_ret - ret_a, 2)), 6) AS mse, round(avg(abs(y_ret - ret_a)), 6) AS mae FROM pred GROUP BY symbol")
def reg_metrics(spark, d):
    return r6(metrics.regression_errors(predictions(spark, d), "y_ret", "ret_a"))


@query(f"WITH {SQL_PRED}, m AS (SELECT symbol, avg(y_ret) AS m FROM pred GROUP BY symbol), k AS (SELECT symbol, avg(abs(y_ret - m)) AS b, avg(abs(y_ret - ret_a)) AS e, stddev_pop(ret_a) / stddev_pop(y_ret) AS q, corr(y_ret, ret_a) AS c FROM pred JOIN m USING (symbol) GROUP BY symbol) SELECT symbol, round(b, 6) AS baseline_mae, round(e, 6) AS model_mae, round(q, 6) AS std_ratio, round(c, 6) AS corr, CASE WHEN abs(b - e) < 0.01 THEN 'same as baseline' WHEN b > e THEN 'better' ELSE 'worse' END AS verdict FROM k")
def mean_baseline(spark, d):
    return r6(metrics.mean_baseline(predictions(spark, d), "y_ret", "ret_a"))


@query()
def adf_returns(spark, d):
    return stats.adf(bars_daily(spark, d).withColumn("log_return", fe.log_return(win.series())), "log_return")


@query()
def pacf20(spark, d):
    return stats.pacf(bars_daily(spark, d).withColumn("log_return", fe.log_return(win.series())), "log_return")


@query()
def qq_residuals(spark, d):
    return stats.qq_normal(stats.residuals(predictions(spark, d), "y_ret", "ret_a"), "residual")


#: Models, scalers and components are fitted on the first 80 %; only the sequence net keeps a part of it for validation.
FITTED = "block <> 'test'"


def _matrix(spark, d) -> DataFrame:
    """Tasks by cores and by the bars' own number: the session's partitions follow the input, which has far more rows."""
    bars = _with_macro(spark, d).persist()
    parts = max(spark.sparkContext.defaultParallelism, -(-bars.count() // models.ROWS))
    return protocol.chrono_split(fe.training_features(bars.repartition(parts, "symbol"))).persist()


def _prepared(spark, d) -> tuple[DataFrame, list[str]]:
    """Training matrix with the lag block reduced and all inputs scaled on all blocks before the test block."""
    df = _matrix(spark, d)
    pca = protocol.fit_lag_pca(df.where(FITTED))
    df = protocol.apply_lag_pca(df, pca)
    cols = inputs(df.columns)
    return models.sized(protocol.apply_scaler(df, protocol.fit_scaler(df.where(FITTED), cols))), cols


@query()
def lag_pca(spark, d):
    df = _matrix(spark, d)
    return protocol.apply_lag_pca(df, protocol.fit_lag_pca(df.where(FITTED), LAG_COLUMNS))


#: The reference's parameters: its best boosters, grid, folds, compared models, search ranges and forest.
DIRECTION, HUBER = Params(trees=200, depth=5, rate=0.01), Params(loss="huber", trees=100, depth=3, rate=0.01)
GRID, FOLDS, TRIALS, SHARES = {"trees": [100, 200], "rate": [0.01, 0.05, 0.1], "depth": [3, 5]}, 5, 100, tuple(k / 10 for k in range(1, 11))
ZOO = {
    "forest": Params(loss="forest", trees=200, depth=8, leaf=15, balanced=True, features=4),
    "gbt": Params(trees=200, depth=4, rate=0.05, sample=0.8),
    "gbt_subsample": Params(trees=300, depth=4, rate=0.05, sample=0.8, columns=0.8, newton=True),
    "gbt_balanced": Params(trees=300, depth=4, rate=0.05, sample=0.8, columns=0.8, newton=True, balanced=True),
}
RANGES = {
    "trees": ("int", 100, 500), "depth": ("int", 2, 8), "rate": ("log", 0.01, 0.3), "sample": ("float", 0.5, 1.0),
    "columns": ("float", 0.5, 1.0), "leaf": ("int", 5, 50), "ridge": ("log", 1e-4, 10.0),
}
ABLATION, BASELINE = Params(trees=200, depth=3, rate=0.05), Params(loss="forest", trees=100, depth=6, leaf=20, balanced=True, features=4)
UP, RETURN = "target_direction", "target_return"


@query()
def gbt_direction(spark, d):
    df, cols = _prepared(spark, d)
    return models.holdout(df.where("block = 'test'"), boosting.fit_model(df.where(FITTED), cols, UP, DIRECTION))


@query()
def gbt_importances(spark, d):
    df, cols = _prepared(spark, d)
    return boosting.fit_model(df.where(FITTED), cols, UP, DIRECTION).importances()


@query()
def huber_return(spark, d):
    df, cols = _prepared(spark, d)
    return models.regression_scores(df.where("block = 'test'"), boosting.fit_model(df.where(FITTED), cols, RETURN, HUBER))


def _compared(df, cols) -> DataFrame:
    """Scores by model and fold: all trees together, and a logistic model."""
    folds = models.sized(protocol.expanding_folds(df.where(FITTED).drop("block"), FOLDS))
    linear = models.cross_validate(folds, lambda train: models.fit_direction(train, cols, kind="logistic"))
    return boosting.compare(df.where(FITTED), cols, UP, ZOO, FOLDS).unionByName(linear.withColumn("model", F.lit("logistic")))


@query()
def model_compare(spark, d):
    df, cols = _prepared(spark, d)
    return metrics.comparison_table(_compared(df, cols))


@query()
def grid_scores(spark, d):
    df, cols = _prepared(spark, d)
    return boosting.search(df.where(FITTED), cols, UP, boosting.grid_points(Params(), GRID), list(GRID), FOLDS)


@query()
def grid_return(spark, d):
    """The grid for the return: Huber loss, by mean absolute error."""
    df, cols = _prepared(spark, d)
    return boosting.search(df.where(FITTED), cols, RETURN, boosting.grid_points(Params(loss="huber"), GRID), list(GRID), FOLDS, "mae")


@query()
def tuned_holdout(spark, d):
    """The comparison table with one more row: the grid's best point, fitted again on all blocks before the test block and scored on that."""
    df, cols = _prepared(spark, d)
    found = boosting.search(df.where(FITTED), cols, UP, boosting.grid_points(Params(), GRID), list(GRID), FOLDS)
    tuned = boosting.refitted(df.where(FITTED), cols, UP, Params(), found, GRID)
    return metrics.comparison_table(_compared(df, cols), models.holdout(df.where("block = 'test'"), tuned).withColumn("model", F.lit("tuned_holdout")))


@query()
def random_search(spark, d):
    """100 points of the reference's ranges; a third of a round's points goes on after each rung."""
    df, cols = _prepared(spark, d)
    return boosting.budgeted_search(df.where(FITTED), cols, UP, Params(newton=True), RANGES, TRIALS, FOLDS)


@query()
def learning_curve(spark, d):
    df, cols = _prepared(spark, d)
    return boosting.learning_curve(df.where(FITTED), cols, UP, BASELINE, SHARES, FOLDS)


@query()
def macro_ablation(spark, d):
    df, cols = _prepared(spark, d)
    test = df.where("block = 'test'")
    with_, without = (models.holdout(test, boosting.fit_model(df.where(FITTED), c, UP, ABLATION)) for c in (cols, [c for c in cols if c != "yield_differential"]))
    return metrics.ablation_table(with_, without, ("accuracy", "roc_auc"))


@query()
def bias_variance(spark, d):
    df, cols = _prepared(spark, d)
    train, val = F.col("block") == "train", F.col("block") == "val"
    scores = boosting.evaluated(df, cols, UP, BASELINE, train, {"train": train, "val": val})
    wide = scores.agg(*[F.max(F.when(F.col("name") == n, F.col("accuracy"))).alias(n) for n in ("train", "val")])
    return stats.bias_variance_verdict(wide, "train", "val")


@query()
def two_head_sequences(spark, d):
    df, cols = _prepared(spark, d)
    seqs = protocol.sequences(df, cols, 20, (RETURN, UP)).persist()
    net = sequence_net.fit_sequences(seqs, F.col("block") == "train", F.col("block") == "val")
    out = net.transform(seqs.where("block = 'test'")).drop("seq").persist()
    return metrics.accuracy(out, UP, "prediction").join(metrics.roc_auc(out, UP, "probability"), "symbol").join(metrics.regression_errors(out, RETURN, "predicted_return"), "symbol")


@query()
def stored_forecast(spark, d):
    """The next session's forecast of every symbol by members that are fitted, saved and loaded again."""
    base = f"{tables.shared_folder(spark)}/members-{uuid.uuid4().hex}"
    df = _matrix(spark, d)
    pca = protocol.fit_lag_pca(df.where(FITTED))
    df = protocol.apply_lag_pca(df, pca)
    cols = inputs(df.columns)
    scaler = protocol.fit_scaler(df.where(FITTED), cols)
    train = protocol.apply_scaler(df, scaler).persist()
    seqs = protocol.sequences(train, cols, 20, (RETURN, UP))
    tables.save_models(
        base, pca=pca, scaler=scaler, direction=boosting.fit_model(train.where(FITTED), cols, UP, Params(trees=10)), huber=boosting.fit_model(train.where(FITTED), cols, RETURN, Params(loss="huber", trees=10)),
        net=sequence_net.fit_sequences(seqs, F.col("block") == "train", F.col("block") == "val", sequence_net.NetParams(epochs=5)),
    )
    members = tables.load_models(spark, base, ["pca", "scaler", "direction", "huber", "net"])
    bars = bars_daily(spark, d)
    found, _ = forecast.forecast_stored(src.tail_n(bars, 100), bars, [("live", macro_daily(spark, d).limit(0)), ("table", macro_daily(spark, d))], members)
    return found.select("symbol", "as_of_date", "forecasting_date", "data_source", "macro_source", "bar_used.close", "consensus.*", F.size("models").alias("members"))


def _ticks(df: DataFrame, keys) -> DataFrame:
    """Columns of a long series: what a row needs lies in its halo."""
    w, x = win.series(keys, "event_id"), F.col("value")
    made = {"change": win.diff(x, w), "mean_21": win.rolling_mean(x, 21, w), "low_20": win.rolling_min(x, 20, w), "high_20": win.rolling_max(x, 20, w), "next": win.lead_(x, 1, w)}
    return df.withColumns(made).select(*keys, "event_id", *made)


@query("SELECT event_id, round(value - lag(value) OVER w, 6) AS change, CASE WHEN count(*) OVER f = 21 THEN round(avg(value) OVER f, 6) END AS mean_21, CASE WHEN count(*) OVER g = 20 THEN min(value) OVER g END AS low_20, CASE WHEN count(*) OVER g = 20 THEN max(value) OVER g END AS high_20, lead(value) OVER w AS next FROM events WINDOW w AS (ORDER BY event_id), f AS (ORDER BY event_id ROWS 20 PRECEDING), g AS (ORDER BY event_id ROWS 19 PRECEDING)")
def tick_features(spark, d):
    """All events as one series: chunks with halos, so that it takes all cores."""
    ticks = spark.read.parquet(f"{d}/events.parquet").select(F.lit("all").alias("symbol"), "event_id", "value")
    return r6(win.by_chunks(ticks, _ticks, halo=21, ahead=1, order="event_id").drop("symbol"))


@query("SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS tick_volume FROM events GROUP BY ALL HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def streamed_bars(spark, d):
    """The events table replayed as a stream; only closed bars come out."""
    path = f"{d}/events.parquet"
    base = f"{tables.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))
    bars = stream_bars(events, "event_type", "value", "ts", order=("event_id",))
    bars.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/bars").awaitTermination()
    return spark.read.parquet(f"{base}/bars").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
