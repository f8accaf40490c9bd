import datetime as dt
import math
import os
import random
from statistics import NormalDist
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tideline.functions import features as fe
from tideline.functions import windows as win
from tideline.operators import align, boosting, forecast, metrics, models, protocol, stats
from tideline.plans.queries import QUERIES, SQL
from tideline.plans.tables import bars_daily
from tideline.schema import FEATURE_COLUMNS, LAG_COLUMNS
from tideline.sources import bars as src
from tideline.sources import tables
from tideline.streaming import streams


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) or 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)[:19].removesuffix(" 00:00:00")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", ["bars_daily_ohlcv", "atr_rsi_macd", "feature_contract", "macro_asof", "history_backfill", "consensus", "forecast_scoring", "expanding_folds", "sequence_windows", "acf20", "roc_auc", "class_report", "basic_set", "eda_set", "next_bar_features", "features_since", "resolved_window", "forecast_display"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    got = QUERIES[name](spark, SMALL)
    want = con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def _bars(spark, closes, symbol="X", start="2026-06-01"):
    day = dt.datetime.fromisoformat(start)
    rows = [(symbol, day + dt.timedelta(days=i), c, c + 1.0, c - 1.0, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume double")


def test_ewm_equals_the_recursion(spark):
    xs = [None, None, *[math.sin(i) * 5 + i % 7 for i in range(3000)]]
    df = spark.createDataFrame([("X", i, x) for i, x in enumerate(xs)], "symbol string, ts int, x double")
    got = [r.y for r in win.with_ewm(df, {"y": ("x", 1 / 3)}).orderBy("ts").collect()]
    want = pd.Series(xs, dtype=float).ewm(alpha=1 / 3, adjust=False).mean()
    assert got[:2] == [None, None]
    assert max(abs(a - b) for a, b in zip(got[2:], want[2:])) < 1e-12


def test_training_features_drop_warm_up_and_never_look_ahead(spark):
    bars = bars_daily(spark, SMALL)
    macro = bars.withColumn("yield_differential", F.lit(1.5))
    n = macro.groupBy("symbol").count().agg(F.sum(F.col("count") - 200)).first()[0]
    assert fe.training_features(macro).count() == n
    cut = macro.where("ts < timestamp_ntz'1998-01-01'")
    a = fe.compute_features(macro).where("ts < timestamp_ntz'1998-01-01'").select("symbol", "ts", F.round("ATR_14", 6), F.round("SMA_200", 6))
    b = fe.compute_features(cut).select("symbol", "ts", F.round("ATR_14", 6), F.round("SMA_200", 6))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_zero_open_gives_no_error(spark):
    bars = _bars(spark, [1.0] * 300).withColumn("open", F.lit(0.0)).withColumn("yield_differential", F.lit(1.5))
    assert fe.training_features(bars).isEmpty()


def test_macro_carries_over_the_weekend_and_loses_prints_between_bars(spark):
    bars = _bars(spark, [1.0, 1.0, 1.0, 1.0], start="2026-06-19")
    prints = [(dt.datetime(2026, 6, 19), 1.5), (dt.datetime(2026, 6, 22), 1.8), (dt.datetime(2026, 6, 20, 12), 9.0)]
    macro = spark.createDataFrame(prints, "ts timestamp_ntz, yield_differential double")
    values = lambda mode: [r.yield_differential for r in align.merge_macro(bars, macro, mode=mode).orderBy("ts").collect()]
    assert values("equi_ffill") == [1.5, 1.5, 1.5, 1.8]
    assert values("asof") == [1.5, 1.5, 9.0, 1.8]


@pytest.mark.parametrize(("members", "want"), [
    ([("UP", 0.6, 0.1), ("UP", 0.7, 0.2)], ("UP", True, 0.65, 0.15)),
    ([("DOWN", 0.55, -0.05), ("UP", 0.8, 0.3)], ("UP", False, 0.8, 0.3)),
    ([("UP", 0.51, 0.02), ("UP", 0.52, 0.04)], ("MIXED / LOW CONFIDENCE", False, 0.515, 0.03)),
    ([("UP", 0.52, 0.02)], ("UP", True, 0.52, 0.02)),
    ([("DOWN", 0.6, -0.1), ("UP", 0.6, 0.1)], ("DOWN", False, 0.6, -0.1)),
])
def test_consensus(spark, members, want):
    rows = [("X", dt.date(2026, 6, 19), f"m{i}", i, *m) for i, m in enumerate(members)]
    df = spark.createDataFrame(rows, "symbol string, as_of_date date, member string, member_order int, direction string, confidence double, predicted_return_pct double")
    r = forecast.consensus(df).first()
    assert (r.direction, r.agreement, round(r.confidence, 9), round(r.predicted_return_pct, 9)) == want


def test_ledger_upsert_and_cache_merge(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    row = lambda d: ("X", dt.date(2026, 6, 19), dt.date(2026, 6, 22), 1.1, d, 0.1, 0.6, {"a": d}, dt.datetime(2026, 6, 19))
    path = str(tmp_path / "log")
    for d in ("DOWN", "UP", "UP"):
        tables.upsert_ledger(spark, spark.createDataFrame([row(d)], tables.LEDGER), path)
    log = tables.read_ledger(spark, path)
    assert [r.pred_direction for r in log.collect()] == ["UP"]
    scored = forecast.score_ledger(log, _bars(spark, [1.108], start="2026-06-22"))
    assert [r.outcome for r in scored.collect()] == ["correct"]
    cache = str(tmp_path / "cache")
    frame = lambda *v: spark.createDataFrame(list(v), "k int, v double")
    tables.merge_cache(spark, frame((1, 0.9), (2, 1.0)), cache, ["k"])
    out = tables.merge_cache(spark, frame((2, 1.1), (3, 1.2)), cache, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, 0.9), (2, 1.1), (3, 1.2)]


def test_split_and_vendor_layouts(spark):
    df = spark.range(15515).selectExpr("'X' symbol", "cast(id as int) ts")
    blocks = {r.block: r["count"] for r in protocol.chrono_split(df).groupBy("block").count().collect()}
    assert blocks == {"train": 10860, "val": 1552, "test": 3103}
    rates = spark.createDataFrame([(1781481600, 1.1, 1.11, 1.09, 1.105, 100000, 5, 0)], "time long, open double, high double, low double, close double, tick_volume long, spread int, real_volume long")
    assert src.from_epoch_rates(rates, "X").first().ts == dt.datetime(2026, 6, 15)
    capital = spark.createDataFrame([(dt.datetime(2026, 6, 19), 1.1, 1.12, 1.09, 1.115)], "Date timestamp_ntz, Open double, High double, Low double, Close double")
    assert src.from_capitalised(capital, "X").first().tick_volume == 0.0


def test_features_share_one_shuffle(spark):
    bars = _bars(spark, [1.0]).withColumn("yield_differential", F.lit(0.0))
    for out in (fe.compute_features(bars), fe.indicator_features(bars), fe.eda_features(bars)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan and "Python" not in plan


def test_without_llm_the_rest_is_registered():
    import __spark_entry__

    assert "feature_contract" in __spark_entry__.queries() and "feature_contract" in __spark_entry__.oracle_sql()


def test_adf_bounds_lags_by_the_length_of_the_series(spark):
    r, xs = random.Random(3), []
    for i in range(400):
        xs.append(0.8 * (xs[i - 15] if i >= 15 else 0.0) + r.gauss(0, 1))
    series = {"long": xs, "short": xs[:60]}
    df = spark.createDataFrame([(s, i, v) for s, vs in series.items() for i, v in enumerate(vs)], "symbol string, ts int, x double")
    got = {row.symbol: row for row in stats.adf(df, "x").collect()}

    def ols(v, k, first):
        d = np.diff(v)
        a = np.array([[v[t], 1.0, *d[t - k : t][::-1]] for t in range(first, len(d))])
        beta, rss = np.linalg.lstsq(a, d[first:], rcond=None)[:2]
        n, m = a.shape
        return beta[0] / math.sqrt(rss[0] / (n - m) * np.linalg.inv(a.T @ a)[0, 0]), n * math.log(rss[0] / n) + 2 * m

    for name, vs in series.items():
        v = np.array(vs)
        most = math.ceil(12 * (len(v) / 100) ** 0.25)
        k = min(range(most + 1), key=lambda q: ols(v, q, most)[1])
        assert got[name].used_lag == k and abs(got[name].statistic - ols(v, k, k)[0]) < 1e-6 and got[name].n_obs == len(v) - 1 - k
    assert got["long"].used_lag > 12


def test_model_queries_do_the_reference_job(monkeypatch, spark):
    from tideline.plans import queries

    df, seen = MagicMock(), {}
    boosting = queries.boosting
    monkeypatch.setattr(queries, "_prepared", lambda spark, d: (df, ["a"]))
    monkeypatch.setattr(queries.protocol, "expanding_folds", lambda df, k: seen.setdefault("folds", []).append(k) or df)
    monkeypatch.setattr(boosting, "search", lambda df, cols, label, points, names, k, *_: seen.setdefault("folds", []).append(k) or seen.update(grid=points))
    monkeypatch.setattr(boosting, "compare", lambda df, cols, label, zoo, k: seen.setdefault("folds", []).append(k) or seen.update(zoo=zoo) or df)
    monkeypatch.setattr(boosting, "budgeted_search", lambda df, cols, label, base, space, n, k: seen.update(space=space, trials=(n, k)))
    monkeypatch.setattr(boosting, "learning_curve", lambda df, cols, label, point, shares, k: seen.update(curve=(point, shares, k)))
    monkeypatch.setattr(boosting, "fit_model", lambda df, cols, label, point: seen.update(direction=point))
    monkeypatch.setattr(queries.metrics, "comparison_table", lambda x: x)
    monkeypatch.setattr(queries.models, "cross_validate", lambda folds, fit: df)
    monkeypatch.setattr(queries.models, "holdout", lambda df, model: None)
    for name in ("grid_scores", "model_compare", "gbt_direction", "random_search", "learning_curve"):
        QUERIES[name](None, "")
    assert seen["folds"] == [5, 5, 5] and seen["direction"].trees == 200 and seen["trials"] == (100, 5)
    assert {(p.trees, p.rate, p.depth) for p in seen["grid"]} == {(t, r, x) for t in (100, 200) for r in (0.01, 0.05, 0.1) for x in (3, 5)}
    assert seen["space"]["trees"] == ("int", 100, 500) and seen["space"]["depth"] == ("int", 2, 8) and seen["space"]["rate"] == ("log", 0.01, 0.3)
    assert min(z.trees for z in seen["zoo"].values()) == 200 and seen["curve"] == (queries.BASELINE, tuple(k / 10 for k in range(1, 11)), 5)
    assert seen["zoo"]["forest"].leaf == 15 and seen["zoo"]["gbt"].sample == 0.8 and queries.BASELINE.leaf == 20 and queries.BASELINE.trees == 100
    assert {k for k, z in seen["zoo"].items() if z.balanced} == {"forest", "gbt_balanced"} and queries.BASELINE.balanced


def test_balanced_classes_leaf_size_and_sampling(spark):
    rows = [(float(k), int(k % 10 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "x double, y int")
    sums = df.withColumn("w", models.class_weights(df, "y")).groupBy("y").agg(F.sum("w")).collect()
    assert all(abs(r[1] - 100) < 1e-9 for r in sums)
    assert models.class_weights(df.limit(0), "y") is not None
    for kind in ("gbt", "gbt_subsample", "forest", "logistic"):
        fitted = models.fit_direction(df, ["x"], "y", trees=2, depth=2, kind=kind, leaf=80, sample=0.9, balanced=True)
        assert models.scored(fitted, df.withColumn("_weight", F.lit("kept"))).select("_weight").distinct().first()[0] == "kept"
    # Of 200 rows with at least 150 in a leaf, no split is left.
    tree = models.fit_direction(df, ["x"], "y", trees=1, depth=3, kind="forest", leaf=150).stages[-1]
    assert tree.trees[0].numNodes == 1
    # With one class of ten rows in ten, the plain model's share of it is a tenth and the balanced one's half.
    plain, even = (models.fit_direction(df.withColumn("x", F.lit(0.0)), ["x"], "y", trees=5, kind="logistic", balanced=b) for b in (False, True))
    p, e = (models.scored(m, df.withColumn("x", F.lit(0.0)).limit(1)).first().probability for m in (plain, even))
    assert abs(p - 0.1) < 1e-3 and abs(e - 0.5) < 1e-3


def test_ewm_fades_over_gaps(spark):
    r = random.Random(5)
    xs = [None] * 3 + [r.gauss(0, 3) if r.random() < 0.6 else None for _ in range(1500)] + [None] * 900 + [2.0, None, 5.0] + [None] * 5
    df = spark.createDataFrame([("X", i, x) for i, x in enumerate(xs)], "symbol string, ts int, x double")
    got = win.with_ewm(df, {"y": ("x", 0.25), "z": ("x", 1.0), "s": ("x", 0.01)}).orderBy("ts").toPandas()
    for name, alpha in (("y", 0.25), ("z", 1.0), ("s", 0.01)):
        want = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=False).mean()
        assert got[name].isna().tolist() == want.isna().tolist() and (got[name] - want).abs().max() < 1e-9, name
    assert list(got.columns) == ["symbol", "ts", "x", "y", "z", "s"]


def test_running_sums_auc_and_qq_by_ranges(spark):
    r = random.Random(6)
    rows = [(r.choice("AB"), r.randint(0, 1), round(r.random(), 2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "symbol string, y int, s double")
    got = {x.symbol: x.roc_auc for x in metrics.roc_auc(df, "y", "s").collect()}
    for k in "AB":
        ones, zeros = ([s for c, y, s in rows if c == k and y == v] for v in (1, 0))
        assert abs(got[k] - sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)) < 1e-12
    out = win.with_running(df, {"n": F.lit(1), "t": F.col("y")}, ["symbol"], "s", rows=250).toPandas()
    for k in "AB":
        part = out[out.symbol == k].sort_values("n")
        assert list(part.n) == list(range(len(part))) and part.s.is_monotonic_increasing and list(part.t) == [0, *part.y.cumsum()[:-1]]
    assert metrics.roc_auc(df.limit(0), "y", "s").isEmpty()
    values = [r.gauss(1, 2) for _ in range(500)]
    q = stats.qq_normal(spark.createDataFrame([("A", x) for x in values], "symbol string, x double"), "x").first()
    m = np.array([(i - 0.3175) / 500.365 for i in range(1, 501)])
    m[0], m[-1] = 1 - 0.5 ** (1 / 500), 0.5 ** (1 / 500)
    place = np.array([NormalDist().inv_cdf(x) for x in m])
    slope, cut = np.polyfit(place, np.sort(values), 1)
    assert abs(q.slope - slope) < 1e-6 and abs(q.intercept - cut) < 1e-6


def test_components_are_fitted_before_the_test_block_alone(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6)) @ r.normal(size=(6, 6))
    x[240:] += 50
    df = spark.createDataFrame([("X", i, *map(float, v)) for i, v in enumerate(x)], ["symbol", "ts", *LAG_COLUMNS])
    df = protocol.chrono_split(df)
    pca = protocol.fit_lag_pca(df.where("block <> 'test'"))
    train = x[:240]
    z = (train - train.mean(0)) / train.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / 240)
    assert np.allclose(pca["mean"], train.mean(0)) and np.allclose(pca["sd"], train.std(0))
    assert np.allclose(pca["explained"], (values[::-1] / values.sum())[: len(pca["explained"])])
    assert len(pca["explained"]) == int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.95, "right")) + 1
    got = protocol.apply_lag_pca(df, pca).orderBy("ts").select("lag_pca_1").toPandas().to_numpy()[:, 0]
    want = ((x - train.mean(0)) / train.std(0)) @ vectors[:, -1]
    assert min(abs(got - want).max(), abs(got + want).max()) < 1e-9


def test_pacf_equals_yule_walker(spark):
    r, xs = random.Random(9), [0.0, 0.0]
    for _ in range(400):
        xs.append(0.5 * xs[-1] - 0.3 * xs[-2] + r.gauss(0, 1))
    got = [x.pacf for x in stats.pacf(spark.createDataFrame([("X", i, v) for i, v in enumerate(xs)], "symbol string, ts int, x double"), "x", 6).orderBy("lag").collect()]
    v = np.array(xs) - np.mean(xs)
    c = [v[: len(v) - k] @ v[k:] / (len(v) - k) for k in range(7)]
    want = [1.0] + [np.linalg.solve([[c[abs(i - j)] for j in range(k)] for i in range(k)], c[1 : k + 1])[-1] for k in range(1, 7)]
    assert np.allclose(got, want)


def test_next_features_after_a_new_bar(spark):
    closes = [1.1 + 0.01 * math.sin(i) for i in range(250)]
    history = _bars(spark, closes, start="2026-01-01").withColumn("yield_differential", F.lit(1.5))
    new = spark.createDataFrame([("X", 1.15, 1.16, 1.14, 1.155, 50000.0, 1.8)], "symbol string, open double, high double, low double, close double, tick_volume double, yield_differential double")
    out = fe.next_features(history, new, 20).orderBy("ts").toPandas()
    assert len(out) == 20 and not out.isna().any().any() and list(out.columns) == ["symbol", "ts", *FEATURE_COLUMNS, "tick_volume"]
    assert abs(out.SMA_21.iloc[-1] - np.mean([*closes[-20:], 1.155])) < 1e-12 and out.yield_differential.iloc[-1] == 1.8
    assert str(out.ts.iloc[-1])[:10] == "2026-09-08"


def test_readers_writers_and_small_operators(spark, tmp_path):
    bars = _bars(spark, [1.0, 2.0, 3.0])
    path = str(tmp_path / "bars")
    tables.write_table(bars, path, partition=["symbol"])
    assert src.read_bars(spark, path).count() == 3
    long = spark.createDataFrame([("a", dt.datetime(2026, 6, d), float(d)) for d in (1, 2, 3)] + [("b", dt.datetime(2026, 6, 1), 9.0)], src.SERIES)
    tables.write_table(long, str(tmp_path / "series"))
    got = src.read_series(spark, str(tmp_path / "series"), ["a"], start=dt.datetime(2026, 6, 2), end=dt.datetime(2026, 6, 3))
    assert sorted(r.value for r in got.collect()) == [2.0, 3.0] and "In(series_id, [a])" in got._jdf.queryExecution().toString() or "EqualTo(series_id,a)" in got._jdf.queryExecution().toString()
    tables.log_run(spark, str(tmp_path / "runs"), "first", {"trees": 3}, {"auc": 0.5})
    tables.log_run(spark, str(tmp_path / "runs"), "second", {}, {})
    assert {r.run_name: r.metrics.get("auc") for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {"first": 0.5, "second": None}
    assert align.default_column(bars, "close", 0.0).columns == bars.columns and align.default_column(bars, "flag", 7).first().flag == 7
    assert align.rename(align.contract(bars, ["ts", "close"]), {"close": "c"}).columns == ["ts", "c"]
    assert align.drop_nulls(bars.withColumn("gap", F.when(F.col("close") > 1, 1.0)), ["gap"]).count() == 2
    assert align.bar_at(bars, bars.where("close = 2")).first().close == 2.0
    assert [r.close for r in src.before_first(bars, bars.where("close > 2")).orderBy("ts").collect()] == [1.0, 2.0]
    named = spark.createDataFrame([("a", 0.2), ("b", 0.7), ("c", 0.1)], "feature string, importance double")
    assert metrics.rank_of(named, "a").first()["rank"] == 2
    assert metrics.best_by(named.toDF("model", "auc"), "auc").first().model == "b"
    os.rename(path, path + ".old")
    assert tables.merge_cache(spark, _bars(spark, [8.0], start="2026-07-01").select("ts", "close", "symbol"), str(tmp_path / "none"), ["symbol", "ts"]).count() == 1


def test_a_cache_survives_a_writer_that_died(spark, tmp_path):
    path = str(tmp_path / "cache")
    frame = lambda *v: spark.createDataFrame(list(v), "k int, v double")
    tables.merge_cache(spark, frame((1, 0.9)), path, ["k"])
    os.rename(path, path + ".old")
    assert sorted(map(tuple, tables.merge_cache(spark, frame((2, 1.0)), path, ["k"]).collect())) == [(1, 0.9), (2, 1.0)]


def test_models_are_saved_and_scored_again(spark, tmp_path):
    r = random.Random(2)
    rows = [("X", i, r.random(), r.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "symbol string, ts int, a double, b double").withColumn("target_return", F.col("a") * 2 - F.col("b")).withColumn("target_direction", (F.col("a") > 0.5).cast("int"))
    direction, huber = models.fit_direction(df, ["a", "b"], trees=3, depth=2), boosting.fit_model(df, ["a", "b"], "target_return", boosting.Params(loss="huber", trees=4, depth=2))
    pca = {"columns": ["a"], "mean": [0.5], "sd": [1.0], "components": [[1.0]]}
    tables.save_models(str(tmp_path), direction=direction, huber=huber, pca=pca)
    back = tables.load_models(spark, str(tmp_path), ["direction", "huber", "pca", "absent"])
    assert set(back) == {"direction", "huber", "pca"} and back["pca"] == pca
    assert models.scored(back["direction"], df).select("ts", "probability").exceptAll(models.scored(direction, df).select("ts", "probability")).isEmpty()
    assert back["huber"].transform(df).exceptAll(huber.transform(df)).isEmpty()
    point = boosting.Params(loss="forest", trees=2, depth=2)
    found = boosting.budgeted_search(df, ["a", "b"], "target_direction", boosting.Params(depth=2), {"trees": ("int", 1, 2)}, 2, 2, rounds=1)
    assert found.count() == 2 and found.first().roc_auc > 0.9
    curve = boosting.learning_curve(df, ["a", "b"], "target_direction", point, (0.5, 1.0), 2).orderBy("share").collect()
    assert [c.share for c in curve] == [0.5, 1.0] and all(c.val_mean > 0.8 for c in curve)


def test_streams_that_run_again_change_nothing(spark, tmp_path):
    bars = _bars(spark, [1.1 + 0.01 * math.sin(i) for i in range(260)]).withColumn("yield_differential", F.lit(1.5))
    store, out, inbox = (str(tmp_path / x) for x in ("store", "out", "in"))
    bars.orderBy("ts").limit(250).write.parquet(f"{store}/batch=-1")
    late = bars.join(bars.orderBy("ts").limit(250).select("ts"), "ts", "left_anti").select(bars.columns)
    late.coalesce(1).write.parquet(inbox)
    for run in (1, 2):
        stream = spark.readStream.schema(late.schema).parquet(inbox)
        streams.stream_features(stream, store, out, str(tmp_path / f"state{run}")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == 10 and spark.read.parquet(store).count() == 260
    want = fe.compute_features(bars).join(late.select("ts"), "ts", "left_semi")
    assert {(r.ts, round(r.SMA_200, 9), round(r.ATR_14, 6)) for r in got.collect()} == {(r.ts, round(r.SMA_200, 9), round(r.ATR_14, 6)) for r in want.collect()}
    row = ("X", dt.date(2026, 6, 19), dt.date(2026, 6, 22), 1.1, "UP", 0.1, 0.6, {"a": "UP"}, dt.datetime(2026, 6, 19))
    spark.createDataFrame([row, row], tables.LEDGER).write.parquet(str(tmp_path / "told"))
    for run in (1, 2):
        told = spark.readStream.schema(tables.LEDGER).parquet(str(tmp_path / "told"))
        streams.stream_upsert(told, str(tmp_path / "ledger"), str(tmp_path / f"s{run}")).trigger(availableNow=True).start().awaitTermination()
    assert tables.read_ledger(spark, str(tmp_path / "ledger")).count() == 1


def test_sources_fall_back_in_order(spark):
    live, old = _bars(spark, [5.0], "A"), _bars(spark, [1.0, 2.0], "A").unionByName(_bars(spark, [3.0], "B"))
    got = {(r.symbol, r.close, r.data_source) for r in src.first_nonempty([("live", live), ("cache", old.where("symbol = 'A'")), ("unavailable", old.withColumn("close", F.lit(0.0)))]).collect()}
    assert got == {("A", 5.0, "live"), ("B", 0.0, "unavailable")}
    got = {(r.symbol, r.data_source) for r in src.backfill(live, old, 2).collect()}
    assert got == {("A", "live"), ("B", "history")}
