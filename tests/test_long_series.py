"""One long series: ranges, chunks with halos, a scan of exponential means, quantiles by refinement, as-of by ranges."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import features as fe
from tideline.functions import windows as win
from tideline.operators import align, stats
from tideline.plans import queries
from tideline.sources.bars import to_bars

START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """Two keys, one ten times longer, dealt at random, with gaps in a column."""
    r = random.Random(1)
    rows, level = [], 1.0
    for key, n in (("long", 3000), ("short", 300)):
        for i in range(n):
            level *= 1 + r.gauss(0, 0.01)
            rows.append((key, START + dt.timedelta(hours=i), level, level * 1.01, level * 0.99, level * (1 + r.gauss(0, 0.003)), float(r.randint(1, 9)), None if i < 5 or r.random() < 0.3 or 900 < i < 1500 else r.gauss(0, 1)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double, gap double").repartition(5).persist()


def same(a, b, on=("symbol", "ts"), tol=1e-9):
    a, b = (x.toPandas().sort_values(list(on)).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and set(a.columns) == set(b.columns)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert (a[c].isna() == b[c].isna()).all(), c
            assert np.allclose(a[c].dropna(), b[c].dropna(), rtol=tol, atol=tol), c
        else:
            assert (a[c] == b[c]).all(), c


@pytest.mark.parametrize("rows", [170, 10**6])
def test_ranges_grow_with_the_rows(series, rows):
    out = win.in_ranges(series, "ts", rows)
    sizes = [r["count"] for r in out.groupBy("_part").count().orderBy("_part").collect()]
    assert len(sizes) == (-(-3300 // rows)) and max(sizes) < 2 * min(rows, 3300)
    edges = out.groupBy("_part").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("_part").collect()
    assert all(x.b < y.a for x, y in zip(edges, edges[1:], strict=False))
    assert win.in_ranges(series.limit(0), "ts").isEmpty()


def test_chunks_hold_their_halos(series):
    out = win.chunks(series.select("symbol", "ts"), 30, 7, rows=100).toPandas()
    for key, part in out.groupby("symbol"):
        n = int(part._at.max()) + 1
        assert sorted(part[part._own]._at) == list(range(n))
        for c, rows in part.groupby("_chunk"):
            assert sorted(rows._at) == list(range(max(0, 100 * c - 30), min(n, 100 * c + 107)))


def test_features_by_chunks_equal_the_keyed_form(series):
    bars = series.drop("gap").withColumn("yield_differential", F.lit(1.5))
    build = lambda df, keys: fe.compute_features(df, keys)
    same(win.by_chunks(bars, build, halo=760, rows=800), fe.compute_features(bars))
    targets = lambda df, keys: df.withColumn("next", win.lead_(F.col("close"), 1, win.series(keys))).withColumn("low20", win.rolling_min(F.col("close"), 20, win.series(keys))).select(*keys, "ts", "next", "low20")
    plan = win.by_chunks(bars, targets, halo=20, ahead=1, rows=90)
    same(plan, targets(bars, ("symbol",)))
    assert win.by_chunks(bars.limit(0), build, halo=760).isEmpty()


@pytest.mark.parametrize("rows", [13, 140, 10**6])
def test_exponential_means_by_a_scan(series, rows):
    columns = {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27), "thin": ("gap", 1 / 14), "all": ("gap", 1.0)}
    keyed = win.with_ewm(series, columns)
    same(win.with_ewm_ranges(series, columns, rows=rows), keyed, tol=1e-11)
    none = win.with_ewm_ranges(series.withColumn("gap", F.lit(None).cast("double")), {"thin": ("gap", 0.5)}, rows=rows)
    assert none.where("thin is not null").isEmpty() and none.count() == 3300


def test_macd_and_atr_on_one_series_without_a_whole_key_window(series):
    """The scan's plan sorts no more than a chunk of a key in one task."""
    one = series.where("symbol = 'long'")
    plan = win.with_ewm_ranges(one.withColumn("_tr", F.col("high") - F.col("low")), {"atr": ("_tr", 1 / 14)}, rows=500)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    # Windows over the key alone run on one row a chunk (the sums of the chunks' sizes).
    keyed = [line for line in text.splitlines() if "windowspecdefinition(symbol" in line and "_part" not in line.split("windowspecdefinition")[1].split("ASC")[0] and "_chunk" not in line.split("windowspecdefinition")[1].split("ASC")[0]]
    assert all("_part" in line for line in keyed)
    same(plan.select("symbol", "ts", "atr"), win.with_ewm(one.withColumn("_tr", F.col("high") - F.col("low")), {"atr": ("_tr", 1 / 14)}).select("symbol", "ts", "atr"), tol=1e-11)


def test_adf_by_chunks(series, spark):
    r = np.random.default_rng(2)
    x = np.cumsum(r.normal(size=4000)) * 0.2 + r.normal(size=4000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(x[:90])], "symbol string, ts int, x double").repartition(4)
    whole, cut, many = (stats.adf(df, "x", chunk=c, max_lag=m).orderBy("symbol").collect() for c, m in ((10**6, None), (150, None), (300, 25)))
    for a, b in zip(whole, cut, strict=True):
        assert (a.symbol, a.used_lag, a.n_obs, a.stationary) == (b.symbol, b.used_lag, b.n_obs, b.stationary) and abs(a.statistic - b.statistic) < 1e-7
    assert len(many) == 2

    def plan(rows):
        out = stats.adf(df, "x", max_lag=rows)
        return len(out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple"))

    assert plan(120) < 1.02 * plan(3)


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(3)
    values = {"wide": r.standard_cauchy(5000), "ties": np.repeat([1.0, 2.0, 7.0], [2500, 100, 1500]), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "skew": np.append(np.zeros(3000), r.random(500))}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("wide", None), ("none", None), (None, 5.0)]
    r.shuffle(rows)
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "symbol string, x double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.731, 1.0)
    for accuracy in (50, 10_000):
        got = {(x.symbol, x.share): x.value for x in stats.quantiles(df, "x", shares, accuracy=accuracy).collect()}
        for k, vs in values.items():
            for s in shares:
                assert np.isclose(got[k, s], np.quantile(vs, s), rtol=1e-12, atol=1e-12), (k, s)
        assert got[None, 0.5] == 5.0 and ("none", 0.5) not in got
    d = {x.symbol: x for x in stats.describe(df, ["x"]).collect()}
    assert np.isclose(d["wide"].q75, np.quantile(values["wide"], 0.75)) and d["wide"]["count"] == 5000 and d["none"]["count"] == 0 and d["none"].q50 is None and d[None].q50 == 5.0


@pytest.mark.parametrize("rows", [40, 10**6])
def test_as_of_by_ranges(series, spark, rows):
    r = random.Random(4)
    prints = sorted(r.sample(range(-50, 3000), 120))
    macro = spark.createDataFrame([(START + dt.timedelta(hours=h), r.random() if r.random() < 0.8 else None, float(h)) for h in prints], "ts timestamp_ntz, a double, b double")
    bars = series.select("symbol", "ts", "close")
    got = align.merge_macro(bars, macro, ["a", "b"], mode="asof", rows=rows).toPandas()
    known = macro.toPandas().sort_values("ts")
    for c in ("a", "b"):
        last = known.dropna(subset=[c])
        at = np.searchsorted(last.ts.to_numpy(), got.ts.to_numpy(), "right") - 1
        want = np.where(at >= 0, last[c].to_numpy()[np.maximum(at, 0)], np.nan)
        assert np.allclose(got[c], want, equal_nan=True) and len(got) == 3300


def test_since_reads_the_warm_up_alone(series, tmp_path, spark):
    path = str(tmp_path / "bars")
    series.repartition(1).sortWithinPartitions("ts").write.parquet(path)
    bars = spark.read.parquet(path)
    start = START + dt.timedelta(hours=2900)
    got = fe.since(bars, F.lit(start), 150)
    rows = got.groupBy("symbol").agg(F.min("ts").alias("a"), F.count("*").alias("n")).collect()
    # The other key has nothing from there on.
    assert [(r.symbol, r.a, r.n) for r in rows] == [("long", START + dt.timedelta(hours=2750), 250)]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(ts,2020-04-01T00:00)" in plan
    assert fe.since(bars, F.lit(START), 150).count() == 3300 and fe.since(bars, F.lit(START + dt.timedelta(days=999)), 5).isEmpty()


@pytest.mark.parametrize("most", [None, 0])
def test_bars_compare_few_events(spark, most):
    """Ties, nulls and NaN in the order and the price, null symbols; few events come to the comparison by the whole order."""
    r = np.random.default_rng(5)
    rows = [(["a", "b", None][i % 3], i % 2, None if i % 97 == 0 else int(r.integers(0, 40)), int(r.integers(0, 3)), float("nan") if i % 53 == 0 else None if i % 59 == 0 else float(r.integers(1, 99))) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, day int, k long, j int, px double").withColumn("t", F.timestamp_seconds(F.col("day") * 86400 + 5)).persist()
    bars = to_bars(df, F.col("s"), F.col("px"), F.col("t"), "day", [F.col("k"), F.col("j")], most)
    plan = bars._jdf.queryExecution().executedPlan().toString()
    by = {}
    for s, day, k, j, px in rows:
        if px is not None and px == px:
            by.setdefault((s, day), []).append(((k is not None, k or 0, j, px), px))
    want = {k: (min(v)[1], max(p for _, p in v), min(p for _, p in v), max(v)[1], float(len(v))) for k, v in by.items()}
    assert {(b.symbol, b.ts.day - 1): (b.open, b.high, b.low, b.close, b.tick_volume) for b in bars.collect()} == want and bars.columns == ["symbol", "ts", "open", "high", "low", "close", "tick_volume"]
    joined = plan.find("BroadcastHashJoin")
    # The join that leaves the ends stands between the events and the aggregate that sorts.
    assert plan.find("SortAggregate") < joined and plan.find("SortAggregate", joined) < 0 if most is None else joined < 0


def test_matrix_tasks_do_not_follow_the_session(spark):
    """The cached matrix of few bars isn't cut into as many partitions as the session has for its input."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert queries._matrix(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.catalog.clearCache()
