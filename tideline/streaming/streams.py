"""Streams: events to closed bars, idempotent forecast upserts, features of new bars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.features import compute_features
from tideline.sources.bars import tail_n
from tideline.sources.tables import upsert_ledger


def stream_bars(events: DataFrame, symbol: str, price: str, ts: str, width: str = "1 day", watermark: str = "1 hour", order: Sequence[str] = ()) -> DataFrame:
    """Bars of a stream of events; in append mode only closed bars come out. ts must be a timestamp."""
    ord_: Column = F.struct(ts, *order, price)
    by = events.withWatermark(ts, watermark).groupBy(F.window(ts, width), F.col(symbol).alias("symbol"))
    bars = by.agg(F.min_by(price, ord_).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ord_).alias("close"), F.count("*").cast("double").alias("tick_volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "tick_volume")


def stream_upsert(forecasts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Every batch replaces the ledger's rows of its keys, so a replay changes nothing."""
    return forecasts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_ledger(batch.sparkSession, batch, path))


def stream_features(bars: DataFrame, store: str, out: str, checkpoint: str, context: int = 900) -> DataStreamWriter:
    """Appends the features of new bars to out; each batch reads the last `context` stored bars of its symbols.

    A batch is stored under its number, and one that runs again takes the place of its first run. store
    holds folders batch=N; bars from before the stream are those with a number below 0.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(store).where(F.col("batch") < number).join(batch.select("symbol").distinct(), "symbol", "left_semi")
        both = tail_n(old, context).select(batch.columns).unionByName(batch).dropDuplicates(["symbol", "ts"])
        rows = compute_features(both).join(batch.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return bars.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def with_context(bars: DataFrame, context: int = 900, keys: str = "symbol", ts: str = "ts") -> DataFrame:
    """New bars of a stream with the last `context` bars of their symbol, held as keyed state: the columns of bars, and fresh.

    A batch costs as much as its own bars and their contexts, however long the history is. fresh marks new bars and, after a
    late one, those that follow it in the context: their features change. A bar that comes again takes the place of the first. One that is
    older than the whole context is still given out, with what is left of it. Null times are left out.
    """
    fields = [f for f in bars.schema.fields if f.name not in (keys, ts)]
    named = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in named.items()), "fresh boolean"])
    zone = named[ts]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).dropna(subset=[ts])
        if new.empty:
            return
        held = new.iloc[:0]
        if state.exists:
            times, values = state.get
            held = pd.DataFrame(np.array(values, float).reshape(len(times), len(fields)), columns=[f.name for f in fields])
            held[ts] = pd.to_datetime(np.array(times, "int64"), unit="us", utc=zone == "timestamp")
            held[ts] = held[ts].astype(new[ts].dtype)
            held[keys] = key[0]
        both = pd.concat([held, new]).drop_duplicates(ts, keep="last").sort_values(ts)
        first = new[ts].min()
        both["fresh"] = both[ts] >= first
        kept = both.tail(context)
        state.update(((kept[ts].astype("datetime64[us]") if zone != "timestamp" else kept[ts].dt.tz_localize(None).astype("datetime64[us]")).astype("int64").tolist(), kept[[f.name for f in fields]].to_numpy(float).ravel().tolist()))
        # What lies before the context of the first new bar is of no use.
        at = int(both["fresh"].to_numpy().argmax())
        yield both.iloc[max(0, at - context) :][[*named, "fresh"]]

    return bars.groupBy(keys).applyInPandasWithState(step, schema, "times array<long>, x array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_state_features(bars: DataFrame, out: str, checkpoint: str, context: int = 900) -> DataStreamWriter:
    """Appends the features of new bars to out, a folder a batch; one that runs again takes the place of its first run.

    The bars before are keyed state (with_context): bars from before the stream come as its first ones.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = compute_features(batch.drop("fresh")).join(batch.where("fresh").select("symbol", "ts"), ["symbol", "ts"], "left_semi")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return with_context(bars, context).writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def latest_features(features: DataFrame) -> DataFrame:
    """Of features that a late bar has changed, those of the last batch. features: as read from stream_state_features' folder."""
    last = Window.partitionBy("symbol", "ts").orderBy(F.desc("batch"))
    return features.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "batch")
