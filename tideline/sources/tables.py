"""Writers: tables, merged caches, the forecast ledger, models and run logs."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.boosting import TreeModel
from tideline.operators.sequence_net import SequenceNet
from tideline.schema import LEDGER, RUNS
from tideline.sources.bars import union_precedence


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; only a session on one machine gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").format(fmt).partitionBy(*partition).save(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def merge_cache(spark: SparkSession, fetched: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Cached and fetched rows, fetched ones winning; no key is ever lost.

    Written beside the cache; the old one is renamed away before the new one takes its place, so that
    one of them is there at any time. A run that finds only the old one goes on from it.
    """
    known = path if exists(spark, path) else f"{path}.old" if exists(spark, f"{path}.old") else None
    merged = union_precedence([spark.read.parquet(known), fetched], keys) if known else union_precedence([fetched], keys)
    merged.write.mode("overwrite").parquet(f"{path}.new")
    fs, p = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(p):
        fs.delete(old, True)
        fs.rename(p, old)
    fs.rename(_fs(spark, f"{path}.new")[1], p)
    fs.delete(old, True)
    return spark.read.parquet(path)


def anti_key(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def upsert(ledger: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("symbol", "as_of_date")) -> DataFrame:
    """The ledger with the forecasts in place of rows of the same key."""
    return anti_key(ledger, forecasts, keys).unionByName(forecasts, allowMissingColumns=True)


def upsert_ledger(spark: SparkSession, forecasts: DataFrame, path: str) -> None:
    """Replaces the partitions (as_of_date) that the forecasts touch; running it again changes nothing."""
    days = forecasts.select("as_of_date").distinct()
    old = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)
    touched = upsert(old.join(days, "as_of_date", "left_semi"), forecasts.dropDuplicates(["symbol", "as_of_date"]))
    # Written elsewhere first, as the partitions that it reads are replaced.
    touched = checkpointed(touched)
    touched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path).orderBy(F.desc("as_of_date"))


def save_models(path: str, **models: MLWritable | TreeModel | SequenceNet | dict) -> None:
    """Fitted pipelines, sums of trees, sequence nets, and parameters of scalers and components (as JSON), each in a folder of its name."""
    for name, model in models.items():
        if isinstance(model, dict):
            SparkSession.active().createDataFrame([(json.dumps(model),)], "value string").write.mode("overwrite").text(f"{path}/{name}/params")
        elif isinstance(model, TreeModel | SequenceNet):
            model.save(f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")


def load_models(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, PipelineModel | TreeModel | SequenceNet | dict]:
    """Those of the named models that are there; each loads by itself."""
    loaders = {"metadata": PipelineModel.load, "trees": TreeModel.load, "net": SequenceNet.load, "params": lambda p: json.loads(spark.read.text(f"{p}/params").first()[0])}
    return {n: load(f"{path}/{n}") for n in names for mark, load in loaders.items() if exists(spark, f"{path}/{n}/{mark}")}


def log_run(spark: SparkSession, path: str, name: str, params: dict, metrics: dict) -> None:
    row = spark.createDataFrame([(name, None, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})], RUNS)
    row.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
