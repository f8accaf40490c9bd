"""Bars from files, vendor layouts and events; fallback and precedence of sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.windows import clean
from tideline.schema import BAR_COLUMNS, BARS, KEYS, ORDER, SERIES

#: Bars that are sent to all tasks at once, at most: some 100 bytes each.
BROADCAST_BARS = 500_000


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).schema(BARS).options(**options).load(path)


def from_epoch_rates(df: DataFrame, symbol: str) -> DataFrame:
    """Vendor rows with time in epoch seconds; spread and real volume are left out."""
    ts = F.timestamp_seconds("time").cast("timestamp_ntz").alias("ts")
    return df.select(F.lit(symbol).alias("symbol"), ts, *[clean(F.col(c).cast("double")).alias(c) for c in ("open", "high", "low", "close", "tick_volume")])


def from_capitalised(df: DataFrame, symbol: str, time: str = "Date") -> DataFrame:
    """Vendor rows with capitalised names; a missing or null volume is 0."""
    volume = F.coalesce(F.col("Volume").cast("double"), F.lit(0.0)) if "Volume" in df.columns else F.lit(0.0)
    return df.select(F.lit(symbol).alias("symbol"), F.col(time).cast("timestamp_ntz").alias("ts"), *[clean(F.col(c).cast("double")).alias(c.lower()) for c in ("Open", "High", "Low", "Close")], volume.alias("tick_volume"))


def read_series(spark: SparkSession, path: str, ids: Sequence[str], start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """(series_id, ts, value) for the ids and the closed time range; both filters reach the scan."""
    df = spark.read.format(fmt).schema(SERIES).load(path).where(F.col("series_id").isin(*ids))
    df = df.where(F.col("ts") >= start) if start is not None else df
    return df.where(F.col("ts") <= end) if end is not None else df


def to_bars(events: DataFrame, symbol: Column, price: Column, ts: Column, unit: str, order: Sequence[Column], most: int | None = None) -> DataFrame:
    """OHLCV bars. order is a total order of the events of a bar (the price ends it); volume counts events.

    The least struct of a group makes Spark sort all events. So a first pass, of plain numbers and thus by hash, finds each
    bar's least and greatest value of the order's first column, and only events with one of these are compared by the whole
    order. Where there are more than `most` bars (BROADCAST_BARS), so that a bar has few events, all events are.
    """
    key = ["symbol", "ts"]
    rows = events.select(symbol.alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts"), clean(price.cast("double")).alias("px"), F.struct(*order, price).alias("ord"), order[0].alias("at")).where("px is not null")
    sides = {"high": F.max("px"), "low": F.min("px"), "tick_volume": F.count("*").cast("double")}
    # Null comes before all values.
    bounds = {"_first": F.when(F.count("at") == F.count("*"), F.min("at")), "_last": F.max("at")}
    bars = rows.groupBy(*key).agg(*[c.alias(n) for n, c in (sides | bounds).items()]).persist()
    if bars.count() <= (BROADCAST_BARS if most is None else most):
        found = bars.withColumnsRenamed({c: f"_{c}" for c in key})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        rows = rows.join(F.broadcast(found), reduce(Column.__and__, same) & (F.col("at").eqNullSafe(F.col("_first")) | F.col("at").eqNullSafe(F.col("_last"))))
        sides = {c: F.first(c) for c in sides}
    else:
        bars.unpersist()
    ends = {"open": F.min_by("px", "ord"), "close": F.max_by("px", "ord")}
    return rows.groupBy(*key).agg(*[(ends | sides)[c].alias(c) for c in BAR_COLUMNS])


def union_precedence(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union; where sources share a key the later one's row stays."""
    tagged = [s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources)]
    w = Window.partitionBy(*keys).orderBy(F.desc("_rank"))
    return reduce(DataFrame.unionByName, tagged).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_rank", "_k")


def first_nonempty(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key the rows of its first source that has any, with the label in data_source."""
    tagged = [s.withColumn("data_source", F.lit(label)).withColumn("_rank", F.lit(k)) for k, (label, s) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.withColumn("_best", F.min("_rank").over(Window.partitionBy(*keys))).where("_rank = _best").drop("_rank", "_best")


def latest_bar(bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    rest = [c for c in bars.columns if c not in keys]
    row = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return row.withColumn("tick_volume", F.coalesce("tick_volume", F.lit(0.0)))


def tail_n(df: DataFrame, n: int | Column, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def bars_needed(live_fetch_bars: int = 250, time_steps: int = 20) -> int:
    return max(live_fetch_bars, 200 + time_steps)


def before_first(history: DataFrame, live: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    first = live.groupBy(*keys).agg(F.min(order).alias("_first"))
    return history.join(first, list(keys)).where(F.col(order) < F.col("_first")).drop("_first")


def backfill(live: DataFrame, history: DataFrame, need: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Live bars, completed to `need` a key by the history's last ones before them; data_source says so.

    A key without live bars takes its last `need` bars from the history.
    """
    have = live.groupBy(*keys).agg(F.count("*").alias("_have"), F.min(order).alias("_first"))
    older = history.join(have, list(keys), "left").where(F.col("_first").isNull() | (F.col(order) < F.col("_first")))
    older = tail_n(older.withColumn("_need", F.lit(need) - F.coalesce("_have", F.lit(0))), F.col("_need"), keys, order).select(history.columns)
    both = union_precedence([older.withColumn("_old", F.lit(1)), live.select(history.columns).withColumn("_old", F.lit(0))], [*keys, order])
    all_of = Window.partitionBy(*keys)
    source = F.when(F.min("_old").over(all_of) == 1, "history").when(F.max("_old").over(all_of) == 1, "live+history_backfill").otherwise("live")
    return both.withColumn("data_source", source).drop("_old")


def append_bar(history: DataFrame, new_bars: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """History with one more bar a key, a calendar day after its last one."""
    last = history.groupBy(*keys).agg(F.max(order).alias("_last"))
    added = new_bars.drop(order).join(last, list(keys)).withColumn(order, F.expr("_last + interval 1 day")).drop("_last")
    return history.unionByName(added, allowMissingColumns=True)
