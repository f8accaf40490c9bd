"""Boosted trees and forests, many fits at once: one pass over the rows a level for all points and folds of a search.

Columns are binned once, at quantiles. Rows lie in blocks (binned columns, labels, row sets, and the running sums
of a group of fits), written to the shared folder. For each level of all trees that grow, tasks add up histograms
of (node, column, bin) over their blocks, one shuffle brings those of a fit and a range of nodes together,
and a few numbers a node (the best split and its sums) come to the driver, which holds the trees. So jobs number trees x
depth, whatever the number of fits. A fit's rows are one of the named row sets: folds and prefixes cost no copy.

Losses: `logistic` (gradient trees, or Newton trees with a ridge), `huber` (clipped residuals; the clip and the medians of the
leaves come from mergeable sketches), `forest` (trees on weighted resamples, several side by side).
Column and row samples are drawn by hashes of row, tree and seed: how rows are dealt over blocks changes nothing but, by
their approximation, the cuts.
"""

from __future__ import annotations

import itertools
import json
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a column, rows in a block, fits whose sums lie in one block, and trees after which the sums are written again.
BINS, ROWS, GROUP, TREES = 32, 131_072, 16, 16
#: Trees of a forest that grow side by side, and nodes whose histograms lie in one shuffled row.
WIDTH, NODES = 40, 16
#: Sketches: buckets of magnitude are at most this factor wide (so values are right to 0.5 %), between these magnitudes.
STEP, LEAST, MOST = 1.01, 1e-12, 1e12
_LOG = np.log(STEP)
_SIDE = int(np.log(MOST / LEAST) / _LOG) + 2


@dataclass(frozen=True)
class Params:
    """sample: share of rows a tree sees (a forest resamples); columns: share of columns a tree may use; features: columns a split may choose from."""

    loss: str = "logistic"
    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    leaf: int = 1
    sample: float = 1.0
    columns: float = 1.0
    features: int | None = None
    balanced: bool = False
    newton: bool = False
    ridge: float = 1.0
    alpha: float = 0.9
    seed: int = 42


@dataclass
class Tree:
    """A heap of nodes: children of k are 2 k + 1 (bin of the feature up to cut) and 2 k + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The deepest node so far of each row of bins."""
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(row):
            f = self.feature[at[row]]
            row = row[f >= 0]
            f = f[f >= 0]
            at[row] = 2 * at[row] + 1 + (x[row, f] > self.cut[at[row]])
        return at


@dataclass
class Fit:
    """One model that grows, until it has that many trees: params on the rows of the set train, scored on the sets in scored.

    pending: trees that the written sums of the rows don't hold yet.
    """

    params: Params
    train: str
    scored: tuple[str, ...] = ()
    stages: tuple[int, ...] = ()
    until: int = 0
    start: float = 0.0
    weights: tuple[float, float] = (1.0, 1.0)
    delta: float = 0.0
    done: int = 0
    begun: int = 0
    growing: dict[int, Tree] = field(default_factory=dict)
    active: dict[int, np.ndarray] = field(default_factory=dict)
    phase: str = "level"
    pending: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    @property
    def live(self) -> bool:
        return self.done < self.until

    def begin(self) -> None:
        """Plants the next trees: one, or several of a forest."""
        while self.phase == "level" and len(self.growing) < (WIDTH if self.params.loss == "forest" else 1) and self.begun < self.until:
            self.growing[self.begun], self.active[self.begun] = Tree.of(self.params.depth), np.zeros(1, np.int64)
            self.begun += 1

    def take(self, number: int, found: list[np.ndarray]) -> None:
        """Moves on by what a pass found: for a level the best splits, for a sketch (group, value)."""
        p = self.params
        if self.phase == "start":
            self.start, self.phase = float(found[0][0, 1]) if found else 0.0, "clip"
        elif self.phase == "clip":
            self.delta, self.phase = float(found[0][0, 1]) if found else 0.0, "level"
        elif self.phase == "leaves":
            for node, value in found[0]:
                self.growing[number].value[int(node)] = p.rate * value
            self.phase, self.active[number] = "clip", np.zeros(0, np.int64)
        else:
            self._split(number, np.concatenate(found) if found else np.zeros((0, 11)))
            if p.loss == "huber" and not len(self.active[number]):
                self.phase = "leaves"

    def _split(self, number: int, rows: np.ndarray) -> None:
        p, tree, after = self.params, self.growing[number], []
        step = 1.0 if p.loss == "forest" else p.rate

        def value(s: np.ndarray) -> float:
            return step * float(s[2] / (s[3] + (p.ridge if p.newton else 0) or 1.0))

        for node, row in zip(self.active[number], rows, strict=False):
            column, total, left = int(row[0]), row[3:7], row[7:11]
            tree.value[node] = value(total)
            if column < 0:
                continue
            tree.feature[node], tree.cut[node] = column, int(row[1])
            self.gains[column] += row[2]
            for child, sums in ((2 * node + 1, left), (2 * node + 2, total - left)):
                tree.value[child] = value(sums)
                if child < 2**p.depth - 1 and sums[0] >= 2 * max(1, p.leaf):
                    after.append(child)
        self.active[number] = np.array(after, np.int64)

    def finish(self) -> bool:
        """Whole trees wait to join the sums. Whether the fit has come to one of its stages."""
        staged = False
        for number in [t for t, a in self.active.items() if not len(a) and self.phase != "leaves"]:
            self.pending.append(self.growing.pop(number))
            del self.active[number]
            self.done += 1
            staged |= self.done in self.stages
        return staged


# ---------------------------------------------------------------- blocks


@dataclass
class Blocks:
    """Binned rows: a DataFrame of (block, rows, x, y, id, sets), the cuts of each column, and (rows, sum of labels) of each set."""

    rows: DataFrame
    columns: list[str]
    cuts: list[np.ndarray]
    sets: dict[str, int]
    sums: dict[str, tuple[int, float]]
    count: int


def cut_points(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Approximate quantiles of each column (rank error: an eighth of a bin), increasing."""
    got = df.approxQuantile(list(columns), [k / bins for k in range(1, bins)], 1 / (8 * bins))
    return [np.unique(np.array(c, float)) for c in got]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value; nulls (NaN) come after all."""
    out = np.empty(values.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, values[:, j], "left")
    return out


def _checkpoint(df: DataFrame) -> DataFrame:
    from tideline.sources.tables import checkpointed

    return checkpointed(df)


def blocks(df: DataFrame, columns: Sequence[str], label: str, sets: Mapping[str, Column], keys: Sequence[str] = ("symbol", "ts"), bins: int = BINS) -> Blocks:
    """df in blocks. sets: named row sets (rows where the condition is null are not in). keys: the columns whose hash is a row's id.

    Rows without a label are left out. An empty table gives no block.
    """
    names, columns = list(sets), list(columns)
    keyed = df.where(F.col(label).isNotNull()).select(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(*keys).alias("id"), F.array(*[F.coalesce(sets[s], F.lit(False)) for s in names]).alias("sets")
    )
    per = keyed.agg(F.count("*").alias("n"), *[f for k in range(len(names)) for f in (F.count_if(F.get("sets", F.lit(k))).alias(f"n{k}"), F.sum(F.when(F.get("sets", F.lit(k)), F.col("y"))).alias(f"y{k}"))]).first()
    cuts = cut_points(df, columns, bins)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def shipped() -> pa.RecordBatch:
            x, y, ids, marks = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            row = [int(ids[0]), len(y), x.tobytes(), y.tobytes(), ids.tobytes(), np.packbits(marks.T, axis=1).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["block", "rows", "x", "y", "id", "sets"])

        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
                marks = batch.column("sets").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
                held.append([binned(x, cuts), batch.column("y").to_numpy(), batch.column("id").to_numpy(), marks])
            if sum(len(h[1]) for h in held) >= ROWS:
                yield shipped()
        if held:
            yield shipped()

    out = keyed.coalesce(max(1, -(-per["n"] // ROWS))).mapInArrow(packed, "block long, rows long, x binary, y binary, id binary, sets binary")
    sums = {s: (per[f"n{k}"], per[f"y{k}"] or 0.0) for k, s in enumerate(names)}
    return Blocks(_checkpoint(out), columns, cuts, {s: k for k, s in enumerate(names)}, sums, per["n"])


# ---------------------------------------------------------------- sketches


def bucket_of(values: np.ndarray) -> np.ndarray:
    """Number of each value's bucket, in the order of the values."""
    size = np.clip(np.abs(values), LEAST, MOST)
    k = np.floor(np.log(size / LEAST) / _LOG).astype(np.int64) + 1
    return np.where(np.abs(values) < LEAST, 0, np.sign(values).astype(np.int64) * k) + _SIDE


def sketch(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group and bucket as one key, count, sum): counts and sums of equal keys may be added."""
    return merged_sketch(group * (2 * _SIDE + 1) + bucket_of(values), np.ones(len(values)), values)


def merged_sketch(key: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, count, len(keys)), np.bincount(at, total, len(keys))


def sketch_groups(key: np.ndarray, count: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, counts, means) of a merged sketch, by value within a group."""
    group = key // (2 * _SIDE + 1)
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(key) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(group[a]), count[a:b], total[a:b] / count[a:b]


def sketch_quantile(count: np.ndarray, mean: np.ndarray, share: float) -> float:
    """The quantile, with the mean of two values where it falls between them; right to half a bucket's width."""
    place = share * (count.sum() - 1)
    below = np.cumsum(count)
    low, high = (mean[min(int(np.searchsorted(below, k, "right")), len(mean) - 1)] for k in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def huber_leaf(count: np.ndarray, mean: np.ndarray, delta: float) -> float:
    """Median plus the mean deviation from it, clipped at delta."""
    middle = sketch_quantile(count, mean, 0.5)
    off = mean - middle
    return middle + float((count * np.sign(off) * np.minimum(np.abs(off), delta)).sum() / count.sum())


# ---------------------------------------------------------------- tasks


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each row id, the same wherever the row is."""
    h = ids.view(np.uint64).copy()
    for s in salt:
        h = (h ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)) / 2.0**53


#: Cumulative Poisson(1): how often a resample takes a row.
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def subsets(p: Params, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """The columns each node may split by, increasing."""
    allowed = np.arange(width)
    if p.columns < 1:
        allowed = np.sort(np.argsort(_uniform(allowed, p.seed, tree, 1), kind="stable")[: max(1, int(p.columns * width))])
    if p.features is None or p.features >= len(allowed):
        return np.tile(allowed, (len(nodes), 1))
    u = _uniform((nodes[:, None] * width + allowed[None, :]).ravel(), p.seed, tree, 2).reshape(len(nodes), -1)
    return np.sort(allowed[np.argsort(u, axis=1, kind="stable")[:, : p.features]], axis=1)


def _block(row: dict, width: int, sets: int) -> tuple[np.ndarray, ...]:
    n = row["rows"]
    marks = np.unpackbits(np.frombuffer(row["sets"], np.uint8).reshape(sets, -1), axis=1, count=n).astype(bool)
    return np.frombuffer(row["x"], np.uint8).reshape(n, width), np.frombuffer(row["y"], float), np.frombuffer(row["id"], np.int64), marks


def _sum(fit: Fit, x: np.ndarray, written: np.ndarray) -> np.ndarray:
    """The running sum of a fit: what is written, and the trees since."""
    out = written.copy()
    for tree in fit.pending:
        out += tree.value[tree.nodes(x)]
    return out


def _gradient(fit: Fit, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, weight x negative gradient, weight x curvature)."""
    w = np.where(y > 0, fit.weights[1], fit.weights[0]) if fit.params.balanced else np.ones(len(y))
    if fit.params.loss == "logistic":
        p = 1 / (1 + np.exp(-f))
        return w, w * (y - p), w * p * (1 - p)
    if fit.params.loss == "huber":
        return w, w * np.clip(y - f, -fit.delta, fit.delta), w
    return w, w * y, w


def _drawn(p: Params, tree: int, ids: np.ndarray) -> np.ndarray | None:
    """How often a tree takes each row; null: once."""
    if p.loss == "forest":
        return np.searchsorted(_POISSON, _uniform(ids, p.seed, tree, 3), "right").astype(float)
    return (_uniform(ids, p.seed, tree, 3) < p.sample).astype(float) if p.sample < 1 else None


def observed(fit: Fit, x: np.ndarray, y: np.ndarray, ids: np.ndarray, f: np.ndarray, bins: int) -> Iterator[tuple[tuple[int, int], object]]:
    """((tree, chunk of nodes), sums over these rows): histograms of rows, weight, gradient and curvature by node, column and bin, or a sketch.

    What other rows give may be added (by added).
    """
    if fit.phase != "level":
        r, at, number = y - f, np.zeros(len(y), np.int64), 0
        if fit.phase == "leaves":
            number, tree = next(iter(fit.growing.items()))
            at, times = tree.nodes(x), _drawn(fit.params, number, ids)
            at, r = (at, r) if times is None else (at[times > 0], r[times > 0])
        yield (number, 0), sketch(at, np.abs(r) if fit.phase == "clip" else r)
        return
    w, g, h = _gradient(fit, y, f)
    for number, tree in fit.growing.items():
        active, times = fit.active[number], _drawn(fit.params, number, ids)
        slot = np.full(len(tree.feature), -1)
        slot[active] = np.arange(len(active))
        at = slot[tree.nodes(x)]
        row = np.flatnonzero((at >= 0) & (times > 0) if times is not None else at >= 0)
        at = at[row]
        columns = subsets(fit.params, number, active, x.shape[1])
        k = columns.shape[1]
        key = ((at[:, None] * k + np.arange(k)) * bins + x[row[:, None], columns[at]]).ravel()
        size = len(active) * k * bins

        def summed(v: np.ndarray) -> np.ndarray:
            return np.bincount(key, np.repeat(v[row] if times is None else v[row] * times[row], k), size)

        rows = np.bincount(key, minlength=size)
        weight = summed(w) if fit.params.balanced or fit.params.loss == "forest" else rows
        out = np.stack([rows, weight, summed(g), summed(h) if fit.params.loss == "logistic" else weight], axis=-1).astype(float).reshape(len(active), k, bins, 4)
        for c in range(0, len(active), NODES):
            yield (number, c // NODES), out[c : c + NODES]


def added(a, b):
    """The sums of two sets of rows."""
    if a is None:
        return b
    return merged_sketch(*(np.concatenate(p) for p in zip(a, b, strict=True))) if isinstance(a, tuple) else a + b


def judged(fit: Fit, number: int, chunk: int, sums, width: int) -> np.ndarray:
    """What the sums of all rows tell: the best splits of the nodes, or (group, value) of a sketch."""
    if fit.phase == "level":
        active = fit.active[number][chunk * NODES : (chunk + 1) * NODES]
        return best_splits(sums, subsets(fit.params, number, active, width), fit.params)
    value = {"start": lambda c, m: sketch_quantile(c, m, 0.5), "clip": lambda c, m: sketch_quantile(c, m, fit.params.alpha), "leaves": lambda c, m: huber_leaf(c, m, fit.delta)}[fit.phase]
    return np.array([(g, value(c, m)) for g, c, m in sketch_groups(*sums)], float).reshape(-1, 2)


def grown(fit: Fit, x: np.ndarray, y: np.ndarray, ids: np.ndarray, f: np.ndarray, bins: int, most: int) -> Fit:
    """The fit after up to most trees, or at its next stage, where these are all of its rows."""
    f, first = f.copy(), len(fit.pending)
    while fit.live and len(fit.pending) - first < most:
        fit.begin()
        sums: dict[int, list[np.ndarray]] = defaultdict(list)
        for (number, chunk), value in observed(fit, x, y, ids, f, bins):
            sums[number].append(judged(fit, number, chunk, value, x.shape[1]))
        f -= fit.start
        for number, found in list(sums.items()):
            fit.take(number, found)
        f += fit.start
        before = len(fit.pending)
        staged = fit.finish()
        for tree in fit.pending[before:]:
            f += tree.value[tree.nodes(x)]
        if staged:
            break
    return fit


def best_splits(hist: np.ndarray, columns: np.ndarray, p: Params) -> np.ndarray:
    """A row a node: (column or -1, cut, gain, then rows, weight, gradient and curvature of all and of the left child).

    Of equal gains the first column, then the lowest cut counts.
    """
    left = np.cumsum(hist, axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    part = (lambda s: s[..., 2] ** 2 / (s[..., 3] + p.ridge)) if p.newton else (lambda s: s[..., 2] ** 2 / np.where(s[..., 1] > 0, s[..., 1], 1))
    gain = part(left) + part(right) - part(total)
    gain[(left[..., 0] < max(1, p.leaf)) | (right[..., 0] < max(1, p.leaf))] = -np.inf
    flat = gain.reshape(len(gain), -1)
    most = flat.max(axis=1)
    # Sums differ in their last digits with the order of the blocks: gains that close are equal.
    at = (flat >= (most - 1e-9 * np.abs(most))[:, None]).argmax(axis=1)
    node = np.arange(len(gain))
    found = most > 1e-9
    column = np.where(found, columns[node, at // hist.shape[2]], -1)
    cut = at % hist.shape[2]
    return np.column_stack([column, cut, np.where(found, most, 0), total[:, 0, 0], left[node, at // hist.shape[2], cut]])


# ---------------------------------------------------------------- the loop


class Grower:
    """Grows fits over blocks: step() is one pass for all live fits, scores() what the stages gave.

    A pass is a level (or a sketch) of the trees in work. Where all rows are one block, a task has all that its fits
    need, and a pass is TREES trees: the same steps, without a shuffle between them.
    """

    def __init__(self, data: Blocks, fits: Sequence[Fit], keep: bool = False):
        self.data, self.fits, self.keep, self.passes = data, list(fits), keep, 0
        self.spark = data.rows.sparkSession
        self.found: list[DataFrame] = []
        self.kept: list[list[Tree]] = [[] for _ in self.fits]
        self.bins = max((len(c) for c in data.cuts), default=0) + 1
        for f in self.fits:
            n, ones = data.sums[f.train]
            if f.params.loss == "logistic":
                share = 0.5 if f.params.balanced else min(max(ones / n if n else 0.5, 1e-9), 1 - 1e-9)
                f.start = float(np.log(share / (1 - share)))
            if f.params.balanced and n:
                f.weights = tuple(n / (2 * k) if k else 1.0 for k in (n - ones, ones))
            f.phase = "start" if f.params.loss == "huber" else "level"
            f.gains = np.zeros(len(data.columns))
            f.until = (f.until or f.params.trees) if n else 0
        # Few rows, many fits: the groups are small enough for every core to have some.
        self.parts = data.rows.count()
        cores = self.spark.sparkContext.defaultParallelism
        groups = max(1, -(-len(self.fits) // GROUP), min(len(self.fits), -(-2 * cores // max(1, self.parts))))
        self.groups = [list(range(k, len(self.fits), groups)) for k in range(groups)]
        state = data.rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("sums", F.lit(None).cast("binary"))
        self.state = _checkpoint(state.repartition(max(1, self.parts) * groups))

    def _each(self, shared, work: Callable) -> Callable:
        """Batches of the state through work(number of the fit, fit, x, y, ids, marks, sum) for every fit of a row that is shared."""
        groups, width, sets = self.groups, len(self.data.columns), len(self.data.sets)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator:
            for batch in batches:
                for row in batch.to_pylist():
                    x, y, ids, marks = _block(row, width, sets)
                    written = np.frombuffer(row["sums"], float).reshape(-1, len(y)) if row["sums"] is not None else None
                    for k, i in enumerate(groups[row["group"]]):
                        if (fit := shared.value.get(i)) is not None:
                            yield from work(i, fit, x, y, ids, marks, _sum(fit, x, written[k] if written is not None else np.full(len(y), fit.start)))

        return rows

    def step(self) -> bool:
        """One pass for every live fit. False once all are done."""
        live = {i: f for i, f in enumerate(self.fits) if f.live}
        if not live:
            return False
        self.passes += 1
        before = {i: len(f.pending) for i, f in live.items()}
        staged = self._whole(live) if self.parts <= 1 else self._level(live)
        if self.keep:
            for i, n in before.items():
                self.kept[i] += self.fits[i].pending[n:]
        if staged:
            self._score(staged)
        # All are written together, so that those in work have few trees to add up in each pass.
        if any(f.live and len(f.pending) >= (TREES if f.params.loss != "forest" else WIDTH) for f in self.fits):
            self._rewrite()
        return True

    def _whole(self, live: dict[int, Fit]) -> list[int]:
        """A pass of up to TREES trees in the one block. Which fits are at a stage."""
        shared, bins, sets = self.spark.sparkContext.broadcast(live), self.bins, self.data.sets

        def work(i, fit, x, y, ids, marks, f):
            row = np.flatnonzero(marks[sets[fit.train]])
            done = pickle.dumps(grown(fit, x[row], y[row], ids[row], f[row], bins, TREES if fit.params.loss != "forest" else WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([done], pa.binary())], ["fit", "grown"])

        for row in self.state.mapInArrow(self._each(shared, work), "fit int, grown binary").toArrow().to_pylist():
            self.fits[row["fit"]] = pickle.loads(row["grown"])
        shared.destroy()
        return [i for i in live if self.fits[i].done in self.fits[i].stages]

    def _level(self, live: dict[int, Fit]) -> list[int]:
        """A pass of one level: sums of every task's blocks, one shuffle, and the splits. Which fits are at a stage."""
        for f in live.values():
            f.begin()
        shared, bins, sets, width = self.spark.sparkContext.broadcast(live), self.bins, self.data.sets, len(self.data.columns)

        def work(i, fit, x, y, ids, marks, f):
            row = np.flatnonzero(marks[sets[fit.train]])
            for (number, chunk), value in observed(fit, x[row], y[row], ids[row], f[row], bins):
                yield (i, number, chunk), value

        each = self._each(shared, work)

        def batch_of(key: tuple, blob: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([blob], pa.binary())], ["fit", "tree", "chunk", "blob"])

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, object] = {}
            for key, value in each(batches):
                held[key] = added(held.get(key), value)
            for key, value in held.items():
                yield batch_of(key, pickle.dumps(value))

        def reduced(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, number, chunk = (k.as_py() for k in key)
            held = None
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    held = added(held, pickle.loads(blob))
            yield batch_of((i, number, chunk), judged(shared.value[i], number, chunk, held, width).tobytes())

        schema = "fit int, tree int, chunk int, blob binary"
        got = self.state.mapInArrow(mapped, schema).groupBy("fit", "tree", "chunk").applyInArrow(reduced, schema).toArrow().to_pylist()
        shared.destroy()
        by: dict[tuple[int, int], list] = defaultdict(list)
        for row in sorted(got, key=lambda r: r["chunk"]):
            fit = live[row["fit"]]
            by[row["fit"], row["tree"]].append(np.frombuffer(row["blob"], float).reshape(-1, 11 if fit.phase == "level" else 2))
        for i, f in live.items():
            for number in list(f.growing) or [0]:
                f.take(number, by.get((i, number), []))
        return [i for i, f in live.items() if f.finish()]

    def _rewrite(self) -> None:
        """Writes the sums with all pending trees."""
        shared, groups, width, sets = self.spark.sparkContext.broadcast(dict(enumerate(self.fits))), self.groups, len(self.data.columns), len(self.data.sets)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = []
                for row in batch.to_pylist():
                    x, y, *_ = _block(row, width, sets)
                    mine = [shared.value[i] for i in groups[row["group"]]]
                    written = np.frombuffer(row["sums"], float).reshape(-1, len(y)) if row["sums"] is not None else [np.full(len(y), j.start) for j in mine]
                    sums.append(np.stack([_sum(j, x, s) for j, s in zip(mine, written, strict=True)]).tobytes())
                yield batch.set_column(batch.schema.get_field_index("sums"), "sums", pa.array(sums, pa.binary()))

        self.state = _checkpoint(self.state.mapInArrow(summed, self.state.schema))
        shared.destroy()
        for f in self.fits:
            f.pending = []

    def _score(self, at: list[int]) -> None:
        """Writes (fit, trees, part, label, score) of the sets that these fits are scored on."""
        shared, sets = self.spark.sparkContext.broadcast({i: self.fits[i] for i in at}), self.data.sets

        def work(i, fit, x, y, ids, marks, f):
            score = {"logistic": lambda: 1 / (1 + np.exp(-f)), "forest": lambda: f / max(1, fit.done), "huber": lambda: f}[fit.params.loss]()
            for part, name in enumerate(fit.scored):
                row = np.flatnonzero(marks[sets[name]])
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int32()), pa.array(np.full(n, fit.done), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(y[row]), pa.array(score[row])], ["fit", "trees", "part", "label", "score"])

        self.found.append(_checkpoint(self.state.mapInArrow(self._each(shared, work), "fit int, trees int, part int, label double, score double")))
        shared.destroy()

    def run(self) -> Grower:
        while self.step():
            pass
        return self

    def scores(self, since: int = 0) -> DataFrame:
        """(fit, trees, part, label, score) from the given stage on: fit is the place in fits, part the place in its scored sets."""
        found = self.found[since:]
        if not found:
            return self.spark.createDataFrame([], "fit int, trees int, part int, label double, score double")
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out

    def model(self, i: int) -> TreeModel:
        f = self.fits[i]
        return TreeModel(self.data.columns, self.data.cuts, f.params.loss, f.start, self.kept[i], f.gains)


# ---------------------------------------------------------------- models


class TreeModel:
    """A sum (or, of a forest, a mean) of trees over binned columns."""

    def __init__(self, columns: Sequence[str], cuts: list[np.ndarray], loss: str, start: float, trees: list[Tree], gains: np.ndarray):
        self.columns, self.cuts, self.loss, self.start, self.trees, self.gains = list(columns), cuts, loss, start, trees, gains

    def sums(self, values: np.ndarray) -> np.ndarray:
        x, out = binned(values, self.cuts), np.full(len(values), self.start)
        for t in self.trees:
            out += t.value[t.nodes(x)]
        return {"logistic": lambda: 1 / (1 + np.exp(-out)), "forest": lambda: out / max(1, len(self.trees)), "huber": lambda: out}[self.loss]()

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Adds predicted_return (Huber loss), or probability and prediction; out names the first."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def summed(*values):
            import pandas as pd

            return pd.Series(shared.value.sums(np.column_stack([np.asarray(v, float) for v in values])))

        name = out or ("predicted_return" if self.loss == "huber" else "probability")
        df = df.withColumn(name, summed(*[F.col(c).cast("double") for c in self.columns]))
        return df if self.loss == "huber" else df.withColumn("prediction", (F.col(name) >= 0.5).cast("int"))

    def importances(self) -> DataFrame:
        """(feature, importance): shares of the gain, best first."""
        total = self.gains.sum() or 1.0
        return SparkSession.active().createDataFrame([(c, float(g / total)) for c, g in zip(self.columns, self.gains, strict=True)], "feature string, importance double").orderBy(F.desc("importance"))

    def save(self, path: str) -> None:
        """Writes one row of JSON for each tree, and one for the rest."""
        rest = {"columns": self.columns, "cuts": [c.tolist() for c in self.cuts], "loss": self.loss, "start": self.start, "gains": self.gains.tolist()}
        rows = [json.dumps({"at": k, **{n: v.tolist() for n, v in asdict(t).items()}}) for k, t in enumerate(self.trees)]
        SparkSession.active().createDataFrame([(json.dumps(rest),), *[(r,) for r in rows]], "value string").write.mode("overwrite").text(f"{path}/trees")

    @classmethod
    def load(cls, path: str) -> TreeModel:
        rows = [json.loads(r[0]) for r in SparkSession.active().read.text(f"{path}/trees").collect()]
        rest = next(r for r in rows if "loss" in r)
        trees = [Tree(np.array(r["feature"], np.int16), np.array(r["cut"], np.uint8), np.array(r["value"])) for r in sorted((r for r in rows if "at" in r), key=lambda r: r["at"])]
        return cls(rest["columns"], [np.array(c) for c in rest["cuts"]], rest["loss"], rest["start"], trees, np.array(rest["gains"]))


def fit_model(df: DataFrame, columns: Sequence[str], label: str, params: Params, keys: Sequence[str] | None = None) -> TreeModel:
    """One model over all rows of df. keys: columns that tell rows apart for sampling (by default the given ones)."""
    data = blocks(df, columns, label, {"all": F.lit(True)}, keys or columns)
    return Grower(data, [Fit(params, "all")], keep=True).run().model(0)


# ---------------------------------------------------------------- searches


def fold_sets(df: DataFrame, k: int = 5, shares: Sequence[float] = (), keys: Sequence[str] = ("symbol",), order: str = "ts") -> tuple[DataFrame, dict[str, Column]]:
    """df with positions, and the row sets of expanding folds: train1, test1, ...; with shares also train1@0.1, ...: the first part of each."""
    from tideline.functions.windows import with_position

    size = F.floor(F.col("_n") / (k + 1))
    sets: dict[str, Column] = {}
    for fold in range(1, k + 1):
        begin = F.col("_n") - (k + 1 - fold) * size
        sets[f"train{fold}"] = F.col("_pos") <= begin
        sets[f"test{fold}"] = (F.col("_pos") > begin) & (F.col("_pos") <= begin + size)
        sets |= {f"train{fold}@{s}": F.col("_pos") <= F.greatest(F.lit(1), F.floor(begin * s)) for s in shares}
    return with_position(df, keys, order).withColumnsRenamed({"pos": "_pos", "n": "_n"}), sets


def stage_scores(grower: Grower, since: int = 0) -> DataFrame:
    """Scores of all scored rows, by Spark: (fit, trees, part, accuracy, precision, recall, f1, roc_auc), or with the Huber loss (…, mse, mae)."""
    from tideline.operators.metrics import accuracy, prf, regression_errors, roc_auc

    keys = ["fit", "trees", "part"]
    if all(f.params.loss == "huber" for f in grower.fits):
        return regression_errors(grower.scores(since), "label", "score", keys)
    s = grower.scores(since).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return accuracy(s, "label", "prediction", keys).join(prf(s, "label", "prediction", keys), keys).join(roc_auc(s, "label", "score", keys), keys)


def cross_validated(df: DataFrame, columns: Sequence[str], label: str, points: Sequence[Params], k: int = 5) -> DataFrame:
    """(point, fold, trees, scores) of every point on every expanding fold, all grown together.

    Points that differ in their number of trees alone are stages of one fit.
    """
    marked, sets = fold_sets(df, k)
    data = blocks(marked, columns, label, sets)
    same: dict[Params, list[int]] = defaultdict(list)
    for i, p in enumerate(points):
        same[replace(p, trees=0)].append(i)
    fits, of = [], []
    for members in same.values():
        stages = tuple(sorted({points[i].trees for i in members}))
        for fold in range(1, k + 1):
            fits.append(Fit(replace(points[members[0]], trees=stages[-1]), f"train{fold}", (f"test{fold}",), stages))
            of.append((fold, [(i, points[i].trees) for i in members]))
    scores = stage_scores(Grower(data, fits).run())
    rows = [(f, t, i, fold) for f, (fold, by) in enumerate(of) for i, t in by]
    return scores.join(F.broadcast(df.sparkSession.createDataFrame(rows, "fit int, trees int, point int, fold int")), ["fit", "trees"]).drop("fit", "part")


def grid_points(base: Params, grid: Mapping[str, Sequence]) -> list[Params]:
    return [replace(base, **dict(zip(grid, values, strict=True))) for values in itertools.product(*grid.values())]


def _table(spark: SparkSession, points: Sequence[Params], names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, {n: str(getattr(p, n)) for n in names}) for i, p in enumerate(points)], "point int, params map<string,string>")


def search(df: DataFrame, columns: Sequence[str], label: str, points: Sequence[Params], names: Sequence[str], k: int = 5, metric: str = "roc_auc") -> DataFrame:
    """(point, params, metric): mean over the folds of every point, best first (of mse and mae the least is best)."""
    mean = cross_validated(df, columns, label, points, k).groupBy("point").agg(F.avg(metric).alias(metric))
    order = F.asc(metric) if metric in ("mse", "mae") else F.desc(metric)
    return _table(df.sparkSession, points, names).join(mean, "point", "left").orderBy(order, "point")


def compare(df: DataFrame, columns: Sequence[str], label: str, zoo: Mapping[str, Params], k: int = 5) -> DataFrame:
    """(model, fold, scores) of each named point."""
    names = df.sparkSession.createDataFrame(list(enumerate(zoo)), "point int, model string")
    return cross_validated(df, columns, label, list(zoo.values()), k).join(F.broadcast(names), "point").drop("point", "trees")


def learning_curve(df: DataFrame, columns: Sequence[str], label: str, point: Params, shares: Sequence[float], k: int = 5) -> DataFrame:
    """(share, train and val accuracy: mean and deviation over the folds), for first parts of the training part."""
    marked, sets = fold_sets(df, k, shares)
    fits = [Fit(point, f"train{fold}@{s}", (f"train{fold}@{s}", f"test{fold}"), (point.trees,)) for s in shares for fold in range(1, k + 1)]
    of = df.sparkSession.createDataFrame([(i, s) for i, (s, _) in enumerate(itertools.product(shares, range(k)))], "fit int, share double")
    rows = stage_scores(Grower(blocks(marked, columns, label, sets), fits).run()).join(F.broadcast(of), "fit")
    part = lambda p: F.when(F.col("part") == p, F.col("accuracy"))
    return rows.groupBy("share").agg(*[f(part(p)).alias(f"{c}_{n}") for p, c in enumerate(("train", "val")) for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def evaluated(df: DataFrame, columns: Sequence[str], label: str, point: Params, train: Column, parts: Mapping[str, Column]) -> DataFrame:
    """(name, scores): one fit on the rows where train holds, scored on the named parts."""
    fit = Fit(point, "train", tuple(parts), (point.trees,))
    names = df.sparkSession.createDataFrame(list(enumerate(parts)), "part int, name string")
    grower = Grower(blocks(df, columns, label, {**parts, "train": train}), [fit])
    return stage_scores(grower.run()).join(F.broadcast(names), "part").drop("fit", "trees", "part")


#: A range of a search: ("int" or "float" or "log", least, most), or ("choice", values).
Space = Mapping[str, tuple]


def _value(kind: tuple, u: float) -> object:
    if kind[0] == "choice":
        return kind[1][min(int(u * len(kind[1])), len(kind[1]) - 1)]
    low, high = (np.log(x) for x in kind[1:]) if kind[0] == "log" else kind[1:]
    x = low + u * (high - low + (kind[0] == "int"))
    return {"int": lambda: min(int(x), kind[2]), "float": lambda: float(x), "log": lambda: float(np.exp(x))}[kind[0]]()


def proposed(known: Sequence[tuple[np.ndarray, float]], width: int, n: int, random: np.random.Generator, draws: int = 24) -> list[np.ndarray]:
    """The next n points of the unit cube: uniform ones until 10 points are known, else those of draws around the best quarter
    whose density among these, against that among the rest, is largest (greater values are better)."""
    if len(known) < 10:
        return list(random.random((n, width)))
    at = np.array([u for u, _ in sorted(known, key=lambda x: x[1], reverse=True)])
    good, rest = np.split(at, [max(3, len(at) // 4)])

    def density(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        spread = max(0.05, 0.25 / len(centres) ** 0.2)
        kernels = np.exp(-(((x[:, None] - centres[None]) / spread) ** 2) / 2) / spread
        # A uniform share keeps every value possible.
        return np.log((kernels.sum(1) + 1) / (len(centres) + 1)).sum(1)

    out = []
    for _ in range(n):
        x = np.abs(good[random.integers(len(good), size=draws)] + random.normal(0, 0.1, (draws, width)))
        x = np.clip(np.where(x > 1, 2 - x, x), 0, 1 - 1e-9)
        x[random.random((draws, width)) < 0.1] = random.random()
        out.append(x[int((density(x, good) - density(x, rest)).argmax())])
    return out


def budgeted_search(
    df: DataFrame, columns: Sequence[str], label: str, base: Params, space: Space, n: int = 100, k: int = 5, metric: str = "roc_auc", rounds: int = 4, rungs: Sequence[float] = (0.2, 0.5, 1.0), keep: float = 1 / 3, seed: int = 42
) -> DataFrame:
    """(point, params, share, metric): n points of the space, best first: by the share of their trees that they came to, then by the metric.

    Points come in rounds, from the second one on where a density estimate of good and other points proposes them. All
    points of a round grow together, on all folds; after each rung (a share of a point's own trees) the best keep of them go on from
    where they are. keep=1 is the full search. The driver holds a number a point.
    """
    marked, sets = fold_sets(df, k)
    data = blocks(marked, columns, label, sets)
    random, points, known = np.random.default_rng(seed), [], []
    sign = -1 if metric in ("mse", "mae") else 1
    for turn in range(rounds):
        cubes = proposed([(u, (rung, sign * m)) for u, m, rung in known if m is not None], len(space), n * (turn + 1) // rounds - n * turn // rounds, random)
        fresh = [replace(base, **{name: _value(kind, x) for (name, kind), x in zip(space.items(), u, strict=True)}) for u in cubes]
        fits = [Fit(p, f"train{fold}", (f"test{fold}",)) for p in fresh for fold in range(1, k + 1)]
        live, grower = list(range(len(fresh))), None
        told, means = [(u, None, 0.0) for u in cubes], {}
        for rung in rungs:
            for i, p in enumerate(fresh):
                for f in fits[i * k : (i + 1) * k] if grower is None else grower.fits[i * k : (i + 1) * k]:
                    f.until = max(1, int(np.ceil(rung * p.trees))) if i in live else f.done
                    f.stages = (f.until,)
            grower = grower or Grower(data, fits)
            since = len(grower.found)
            scores = stage_scores(grower.run(), since)
            # A point of few trees may have come to this rung already: its score stands.
            means |= {r["point"]: r[metric] for r in scores.groupBy(F.floor(F.col("fit") / k).alias("point")).agg(F.avg(metric).alias(metric)).collect()}
            for i in live:
                told[i] = (cubes[i], means.get(i), rung)
            ranked = sorted((i for i in live if means.get(i) is not None), key=lambda i: (-sign * means[i], i))
            live = ranked[: max(1, int(np.ceil(keep * len(live))))]
        known += told
        points += fresh
    rows = [(i, float(rung), None if m is None else float(m)) for i, (_, m, rung) in enumerate(known)]
    out = _table(df.sparkSession, points, list(space)).join(df.sparkSession.createDataFrame(rows, f"point int, share double, {metric} double"), "point")
    return out.orderBy(F.desc("share"), F.asc_nulls_last(metric) if sign < 0 else F.desc_nulls_last(metric), "point")


def refitted(df: DataFrame, columns: Sequence[str], label: str, base: Params, found: DataFrame, space: Space | Mapping[str, Sequence]) -> TreeModel:
    """The model of the first point of a search's table, fitted on all rows of df."""
    best = found.first()["params"]
    kinds = {n: type(getattr(base, n)) if getattr(base, n) is not None else int for n in space}
    return fit_model(df, columns, label, replace(base, **{n: None if best[n] == "None" else kinds[n](best[n]) for n in space}), ("symbol", "ts"))
