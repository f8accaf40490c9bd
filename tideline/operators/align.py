"""Joins and alignment of bars, macro series, ledgers and actual prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.windows import RANGE_ROWS, ffill, in_ranges, series
from tideline.schema import KEYS, ORDER


def contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def default_column(df: DataFrame, name: str, value) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def round_all(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def bar_at(bars: DataFrame, asof: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    return bars.join(asof.select(*keys, order), [*keys, order], "left_semi")


def require_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with n or more, and the other keys with the reason."""
    count = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    few = count.where(F.col("rows") < n).withColumn("reason", F.lit(f"fewer than {n} usable rows"))
    return df.join(few, list(keys), "left_anti"), few


def coverage(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg((F.count(column) / F.count("*")).alias("coverage"))


def merge_macro(bars: DataFrame, macro: DataFrame, column: str | Sequence[str] = "yield_differential", mode: str = "equi_ffill", keys: Sequence[str] = KEYS, order: str = ORDER, rows: int = RANGE_ROWS) -> DataFrame:
    """Bars with the macro value known by then; never filled backwards.

    equi_ffill: the value printed at the bar's own time, carried forward along the bars, so a print
    between bars is lost. asof: the last print at or before the bar, of one column or of several.
    """
    w = series(keys, order)
    if mode == "equi_ffill":
        return bars.drop(column).join(macro.select(order, column), order, "left").withColumn(column, ffill(F.col(column), w))
    columns = [column] if isinstance(column, str) else list(column)
    times = bars.select(order).distinct().withColumn("_bar", F.lit(1))
    both = times.unionByName(macro.select(order, *[F.col(c).alias(f"_v_{c}") for c in columns], F.lit(0).alias("_bar")), allowMissingColumns=True)
    known = carried(both, {c: f"_v_{c}" for c in columns}, order, "_bar", rows).where("_bar = 1").select(order, *columns)
    return bars.drop(*columns).join(known, order, "left")


def carried(df: DataFrame, columns: dict[str, str], order: str = ORDER, then: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """df with each out: the last value of its column so far, by order (then by `then`), over the whole table and in no single task.

    Rows are dealt by ranges of the order; within one the last value is a window's, and before a range's first value the one that
    the ranges before it end with holds: a table of one row a range carries that on.
    """
    dealt = in_ranges(df, order, rows)
    by = [order, *([then] if then else [])]
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by))).alias(f"_e_{n}") for n, c in columns.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", *[F.last(f"_e_{n}", True).over(earlier).alias(f"_e_{n}") for n in columns])
    out = dealt.join(F.broadcast(ends), "_part")
    return out.withColumns({n: F.coalesce(F.last(c, True).over(inside), F.col(f"_e_{n}")) for n, c in columns.items()}).drop("_part", *[f"_e_{n}" for n in columns])


def align_spread(long: DataFrame, left_id: str = "us10y", right_id: str = "de10y", order: str = ORDER) -> DataFrame:
    """Both series on all their times, each carried forward, and their difference; rows with a null are dropped."""
    wide = long.groupBy(order).pivot("series_id", [left_id, right_id]).agg(F.first("value"))
    filled = carried(wide, {f"_f_{c}": c for c in (left_id, right_id)}, order).select(order, *[F.col(f"_f_{c}").alias(c) for c in (left_id, right_id)])
    return filled.withColumn("yield_differential", F.col(left_id) - F.col(right_id)).na.drop("any")


def inner_aligned(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on)).na.drop("any")


def join_actuals(ledger: DataFrame, bars: DataFrame, closed_before: Column | None = None, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Adds actual_close: the last close of the date that was forecast, of bars closed before a time if given."""
    done = bars.where(F.col(order) < closed_before) if closed_before is not None else bars
    closes = done.groupBy(*keys, F.to_date(order).alias("forecasting_date")).agg(F.max_by("close", order).alias("actual_close"))
    return ledger.join(closes, [*keys, "forecasting_date"], "left")
