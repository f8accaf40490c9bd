"""The grower of many fits against a plain one, over one block and many; searches, sketches, models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import boosting as b

COLUMNS = [f"c{k}" for k in range(5)]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 5)).round(3)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + r.normal(size=500) > 0).astype(int)
    z = x[:, 0] + (x[:, 3] > 0) + r.standard_t(2, size=500) / 4
    rows = [(*map(float, row), int(t), float(v), "a" if i % 3 else "b", i) for i, (row, t, v) in enumerate(zip(x, y, z, strict=True))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS) + ", y int, z double, symbol string, ts int").persist(), x, y, z


def plain_tree(x, g, h, w, depth, leaf, rate):
    """A function of rows of bins: one tree by looping over every node, column and cut."""
    value = rate * g.sum() / (h.sum() or 1.0)
    best = None
    if depth:
        for j in range(x.shape[1]):
            for c in range(int(x[:, j].max())):
                left = x[:, j] <= c
                if min(left.sum(), (~left).sum()) < leaf:
                    continue
                gain = sum(g[s].sum() ** 2 / w[s].sum() for s in (left, ~left)) - g.sum() ** 2 / w.sum()
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, j, c
    if best is None:
        return lambda rows: np.full(len(rows), value)
    _, j, c = best
    left = x[:, j] <= c
    sides = [plain_tree(x[s], g[s], h[s], w[s], depth - 1 if s.sum() >= 2 * leaf else 0, leaf, rate) for s in (left, ~left)]
    return lambda rows: np.where(rows[:, j] <= c, sides[0](rows), sides[1](rows))


def plain_boosting(x, y, new, trees, depth, leaf, rate, weights=(1.0, 1.0)):
    w = np.where(y > 0, weights[1], weights[0])
    share = (w * y).sum() / w.sum()
    f, out = (np.full(len(v), np.log(share / (1 - share))) for v in (x, new))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = plain_tree(x, w * (y - p), w * p * (1 - p), w, depth, leaf, rate)
        f, out = f + tree(x), out + tree(new)
    return 1 / (1 + np.exp(-out))


@pytest.mark.parametrize("rows", [131_072, 90])
@pytest.mark.parametrize(("depth", "leaf", "balanced"), [(1, 1, False), (3, 12, False), (4, 3, True)])
def test_equals_a_plain_grower(table, monkeypatch, rows, depth, leaf, balanced):
    monkeypatch.setattr(b, "ROWS", rows)
    monkeypatch.setattr(b, "TREES", 4)
    df, x, y, _ = table
    # Dealt over partitions, so that there are several blocks.
    model = b.fit_model(df.repartition(8).where("symbol is not null"), COLUMNS, "y", b.Params(trees=9, depth=depth, leaf=leaf, rate=0.3, balanced=balanced), ("ts",))
    bins = b.binned(x, model.cuts)
    weights = (len(y) / (2 * (y == 0).sum()), len(y) / (2 * y.sum())) if balanced else (1.0, 1.0)
    assert np.allclose(model.sums(x), plain_boosting(bins, y, bins, 9, depth, leaf, 0.3, weights), atol=1e-9)
    got = model.transform(df).select("ts", "probability", "prediction").orderBy("ts").collect()
    assert np.allclose([r.probability for r in got], model.sums(x)) and all(r.prediction == (r.probability >= 0.5) for r in got)


KINDS = [
    b.Params(trees=6, depth=3, rate=0.2, sample=0.7, columns=0.6, newton=True),
    b.Params(loss="forest", trees=7, depth=4, leaf=5, features=2, balanced=True),
    b.Params(loss="huber", trees=5, depth=2, rate=0.3),
]


@pytest.mark.parametrize("point", KINDS)
def test_blocks_change_nothing(table, monkeypatch, point):
    """Samples, forests and sketches: one block, several, and fits beside each other."""
    df, x, *_ = table
    label = "z" if point.loss == "huber" else "y"
    monkeypatch.setattr(b, "WIDTH", 3)
    # Cuts are approximate quantiles, which may differ with the partitions: the same ones here.
    monkeypatch.setattr(b, "cut_points", lambda *_, cuts=b.cut_points(df, COLUMNS): cuts)
    want = b.fit_model(df, COLUMNS, label, point, ("ts",)).sums(x)
    monkeypatch.setattr(b, "ROWS", 64)
    monkeypatch.setattr(b, "TREES", 2)
    assert np.allclose(b.fit_model(df.repartition(6), COLUMNS, label, point, ("ts",)).sums(x), want)
    data = b.blocks(df.repartition(6), COLUMNS, label, {"all": F.lit(True), "some": F.col("ts") < 300}, ("ts",))
    many = b.Grower(data, [b.Fit(point, "some"), b.Fit(point, "all"), b.Fit(point, "all")], keep=True).run()
    assert np.allclose(many.model(1).sums(x), want) and np.allclose(many.model(2).sums(x), want) and not np.allclose(many.model(0).sums(x), want)


def test_passes_do_not_grow_with_the_fits(table, monkeypatch):
    monkeypatch.setattr(b, "ROWS", 64)
    df, *_ = table
    data = b.blocks(df.repartition(4), COLUMNS, "y", {"all": F.lit(True)}, ("ts",))
    growers = [b.Grower(data, [b.Fit(b.Params(trees=3, depth=2, rate=0.1 + 0.1 * k), "all") for k in range(n)]).run() for n in (1, 8)]
    assert [g.passes for g in growers] == [6, 6]


def test_huber_step_and_sketches(table):
    """One tree on clipped residuals; medians and clip from sketches are right to the width of a bucket."""
    df, x, _, z = table
    model = b.fit_model(df, COLUMNS, "z", b.Params(loss="huber", trees=1, depth=2, rate=1.0, alpha=0.8), ("ts",))
    start = np.median(z)
    r = z - start
    delta = np.quantile(np.abs(r), 0.8)
    bins = b.binned(x, model.cuts)
    place = model.trees[0].nodes(bins)
    assert abs(model.start - start) < 0.006 * abs(start) + 1e-9
    g = np.clip(r, -delta, delta)
    tree = plain_tree(bins, g, np.ones(500), np.ones(500), 2, 1, 1.0)
    assert len(set(zip(place.tolist(), tree(bins).round(9).tolist(), strict=True))) == len(set(place.tolist()))
    for node in set(place.tolist()):
        s = r[place == node]
        off = s - np.median(s)
        want = np.median(s) + (np.sign(off) * np.minimum(np.abs(off), delta)).mean()
        assert abs(model.trees[0].value[node] - want) < 0.01 * (np.abs(s).mean() + delta)
    v = np.random.default_rng(1).standard_t(1, 4000) * 10.0
    half = [b.sketch(np.zeros(len(p), int), p) for p in (v[:1000], v[1000:])]
    (_, count, mean), = b.sketch_groups(*b.added(*half))
    for share in (0.01, 0.3, 0.5, 0.9, 0.999):
        want = np.quantile(v, share)
        assert abs(b.sketch_quantile(count, mean, share) - want) <= 0.0101 * abs(want) + 1e-9


def test_grid_zoo_curve_and_holdout(table):
    df, *_ = table
    points = b.grid_points(b.Params(), {"trees": [3, 6], "rate": [0.1, 0.3], "depth": [2]})
    got = b.search(df, COLUMNS, "y", points, ["trees", "rate"], k=3).collect()
    assert len(got) == 4 and [r.roc_auc for r in got] == sorted((r.roc_auc for r in got), reverse=True)
    # A point alone, and fold by fold with plain rows.
    marked, sets = b.fold_sets(df, 3)
    folds = []
    for k in (1, 2, 3):
        train, test = (marked.where(sets[f"{s}{k}"]).toPandas() for s in ("train", "test"))
        cuts = b.cut_points(marked, COLUMNS)
        p = plain_boosting(b.binned(train[COLUMNS].to_numpy(), cuts), train.y.to_numpy(), b.binned(test[COLUMNS].to_numpy(), cuts), 6, 2, 1, 0.3)
        pos, neg = p[test.y == 1], p[test.y == 0]
        folds.append(np.mean([(a > c) + (a == c) / 2 for a in pos for c in neg]))
    assert abs(next(r.roc_auc for r in got if r.params == {"trees": "6", "rate": "0.3"}) - np.mean(folds)) < 1e-9
    zoo = {"boosted": points[0], "forest": b.Params(loss="forest", trees=4, depth=3, features=2)}
    assert b.compare(df, COLUMNS, "y", zoo, 3).groupBy("model").count().collect().__len__() == 2
    curve = b.learning_curve(df, COLUMNS, "y", b.Params(loss="forest", trees=3, depth=2), (0.1, 0.5, 1.0), 3).orderBy("share").collect()
    assert [r.share for r in curve] == [0.1, 0.5, 1.0] and all(0 <= r.val_mean <= 1 and r.train_std is not None for r in curve)
    parts = {r.name: r.accuracy for r in b.evaluated(df, COLUMNS, "y", points[3], F.col("ts") < 300, {"train": F.col("ts") < 300, "test": F.col("ts") >= 300}).collect()}
    assert parts["train"] > 0.7 > parts["test"] * 0.5
    best = b.refitted(df, COLUMNS, "y", b.Params(depth=2), b.search(df, COLUMNS, "y", points, ["trees", "rate"], k=3), {"trees": [], "rate": []})
    assert len(best.trees) == int(got[0].params["trees"])


def test_budgeted_search_finds_the_full_one_s_best(table):
    # A clear case: stumps can't see a product, so depth and rate decide early.
    df = table[0].withColumn("y", (F.col("c0") * F.col("c1") > 0).cast("int"))
    space = {"trees": ("int", 8, 24), "depth": ("int", 1, 3), "rate": ("log", 0.01, 0.5), "sample": ("float", 0.6, 1.0), "features": ("choice", [None, 2])}
    full, short = (b.budgeted_search(df, COLUMNS, "y", b.Params(), space, n=12, k=2, rounds=1, keep=keep, seed=5).collect() for keep in (1.0, 0.5))
    assert len(full) == len(short) == 12 and all(r.share == 1.0 for r in full)
    assert short[0].params == full[0].params and abs(short[0].roc_auc - full[0].roc_auc) < 1e-12
    assert sorted(r.share for r in short) == [0.2] * 6 + [0.5] * 3 + [1.0] * 3
    for r in full:
        assert 8 <= int(r.params["trees"]) <= 24 and 0.01 <= float(r.params["rate"]) <= 0.5 and r.params["features"] in ("None", "2")


def test_proposals_follow_the_good_points():
    for seed in range(5):
        random = np.random.default_rng(seed)

        def far(u):
            return abs(u[..., 0] - 0.8) + abs(u[..., 1] - 0.2)

        known = [(u, -far(u)) for u in random.random((40, 2))]
        got = np.array(b.proposed(known, 2, 40, random))
        assert far(got).mean() < 0.6 * far(random.random((4000, 2))).mean() and got.min() >= 0 and got.max() < 1
    assert np.array(b.proposed(known[:3], 2, 5, random)).shape == (5, 2)


def test_tables_without_rows_or_with_one_class(table):
    df, x, *_ = table
    empty = b.fit_model(df.limit(0), COLUMNS, "y", b.Params(trees=2), ("ts",))
    assert not empty.trees and np.allclose(empty.sums(x), 0.5)
    one = b.fit_model(df.where("y = 1"), COLUMNS, "y", b.Params(trees=2), ("ts",))
    assert one.sums(x).min() > 0.99
    gaps = df.withColumn("c0", F.when(F.col("ts") % 2 == 0, F.col("c0"))).withColumn("y", F.when(F.col("ts") > 5, F.col("y")))
    model = b.fit_model(gaps, COLUMNS, "y", b.Params(trees=3), ("ts",))
    assert model.transform(gaps).where("probability is null").isEmpty()


def test_models_come_back(spark, table, tmp_path):
    df, x, *_ = table
    for point in KINDS:
        model = b.fit_model(df, COLUMNS, "z" if point.loss == "huber" else "y", point, ("ts",))
        model.save(str(tmp_path / point.loss))
        assert np.array_equal(b.TreeModel.load(str(tmp_path / point.loss)).sums(x), model.sums(x))
        assert abs(sum(r.importance for r in model.importances().collect()) - 1) < 1e-9
