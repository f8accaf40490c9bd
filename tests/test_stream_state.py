"""Features of streamed bars by keyed state: batches, a late bar, a bar that comes again, a replay."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tideline.functions.features import compute_features
from tideline.streaming import streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double, yield_differential double"


def bars(spark, symbol, days):
    rows = [(symbol, START + dt.timedelta(days=d), *(float(f(d)) for f in (lambda d: 1 + 0.1 * math.sin(d), lambda d: 1.2 + 0.1 * math.sin(d), lambda d: 0.8 + 0.1 * math.sin(d), lambda d: 1 + 0.1 * math.sin(d + 1), lambda d: d % 7, lambda d: 1.5))) for d in days]
    return spark.createDataFrame(rows, SCHEMA)


def test_features_by_state(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        streams.stream_state_features(stream, out, mark, context=700).trigger(availableNow=True).start().awaitTermination()
        return streams.latest_features(spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")))

    def same(got, days):
        want = compute_features(bars(spark, "A", days)).orderBy("ts").toPandas()
        got = got.where("symbol = 'A'").orderBy("ts").toPandas()[want.columns]
        assert list(got.ts) == list(want.ts)
        for c in want.columns[2:]:
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-12), c

    days = [d for d in range(300) if d != 260]
    bars(spark, "A", days[:240]).unionAll(bars(spark, "B", range(30))).coalesce(1).write.parquet(f"{inbox}/0")
    bars(spark, "A", days[240:270]).coalesce(1).write.parquet(f"{inbox}/1")
    inbox = f"{inbox}/*"
    same(run(), days[:270])
    # One more batch, with a bar that comes again.
    bars(spark, "A", days[269:]).coalesce(1).write.parquet(f"{inbox[:-2]}/2")
    same(run(), days)
    # A late bar: features of all that follow it change.
    bars(spark, "A", [260]).coalesce(1).write.parquet(f"{inbox[:-2]}/3")
    same(run(), range(300))
    rows = spark.read.parquet(out).where("symbol = 'A'").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in rows][-1] == 40 and spark.read.parquet(out).where("symbol = 'B'").count() == 30
    # Started anew without new files, nothing comes in addition.
    same(run(), range(300))
    assert spark.read.parquet(out).groupBy("batch").count().count() == len(rows)


def test_a_batch_reads_its_context_alone(spark, tmp_path):
    inbox, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    sizes = []

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{inbox}/*")
        streams.with_context(stream, 50).writeStream.option("checkpointLocation", mark).foreachBatch(lambda b, _: sizes.append(b.count())).trigger(availableNow=True).start().awaitTermination()

    for k, days in enumerate((range(0, 400), range(400, 410), range(410, 420), [0])):
        bars(spark, "A", days).coalesce(1).write.parquet(f"{inbox}/{k}")
        run()
    assert sizes == [400, 60, 60, 51]
