"""Bars and series that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.features import target_return
from tideline.functions.windows import series, with_position
from tideline.sources.bars import to_bars


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return to_bars(df, F.col("l_returnflag"), F.col("l_extendedprice"), F.col("l_shipdate"), "day", [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return to_bars(df, F.col("event_type"), F.col("value"), F.col("ts"), "hour", [F.col("ts"), F.col("event_id")])


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, value): a daily and a monthly series made of order prices. The prime divisor avoids ties when rounding."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    ts = F.when(urgent, F.date_trunc("day", "o_orderdate")).otherwise(F.date_trunc("month", "o_orderdate")).cast("timestamp_ntz")
    return o.groupBy(F.when(urgent, "us10y").otherwise("de10y").alias("series_id"), ts.alias("ts")).agg((F.avg("o_totalprice") / 99991).alias("value"))


def macro_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_long(spark, sf_dir).where("series_id = 'us10y'").select("ts", F.col("value").alias("yield_differential"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with two deterministic members' probabilities and returns, and the true label."""
    df = with_position(bars_daily(spark, sf_dir)).withColumn("y_ret", target_return(series())).where("y_ret is not null")
    pos = F.col("pos")
    return df.withColumns({"p_a": ((pos * 37) % 101) / 100.0, "p_b": ((pos * 53) % 97) / 96.0, "ret_a": ((pos * 29) % 41 - 20) / 100.0, "ret_b": ((pos * 31) % 43 - 21) / 100.0, "label": (F.col("y_ret") > 0).cast("int")}).withColumn("pred", (F.col("p_a") >= 0.5).cast("int"))


def sql_bars(name: str = "bars") -> str:
    order = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    return f"""{name} AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
  first(l_extendedprice {order}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  last(l_extendedprice {order}) AS close, count(*)::DOUBLE AS tick_volume
  FROM lineitem GROUP BY ALL)"""


SQL_MACRO = """urgent AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 99991 AS v
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
slow AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 99991 AS v
  FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)"""

SQL_PRED = f"""{sql_bars()},
ranked AS (SELECT *, row_number() OVER s AS pos, (lead(close) OVER s - close) / close * 100 AS y_ret FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
pred AS (SELECT *, ((pos * 37) % 101) / 100.0::DOUBLE AS p_a, ((pos * 53) % 97) / 96.0::DOUBLE AS p_b, ((pos * 29) % 41 - 20) / 100.0::DOUBLE AS ret_a,
  ((pos * 31) % 43 - 21) / 100.0::DOUBLE AS ret_b, (y_ret > 0)::INT AS label, (((pos * 37) % 101) / 100.0::DOUBLE >= 0.5)::INT AS pred FROM ranked WHERE y_ret IS NOT NULL)"""
