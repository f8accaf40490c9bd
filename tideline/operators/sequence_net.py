"""A joint learner of return and direction on windows of bars: one shared layer, two heads, trained together.

Windows lie in blocks of 32-bit floats in the shared folder. A step sums the gradients of a mini-batch over all
blocks in one job (tasks add up theirs first); the driver holds the weights and takes the step (Adam). After each epoch
the summed loss on the validation windows decides whether to go on: without a better one for `patience` epochs training stops,
and the best weights stay.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.boosting import _checkpoint, _uniform

#: Windows in a block.
ROWS = 2048


@dataclass(frozen=True)
class NetParams:
    """batches: mini-batches of an epoch (a window's batch is drawn anew each epoch)."""

    hidden: int = 64
    rate: float = 0.002
    epochs: int = 100
    batches: int = 6
    patience: int = 10
    ridge: float = 1e-4
    seed: int = 42


Weights = dict[str, np.ndarray]


def first_weights(width: int, p: NetParams) -> Weights:
    r = np.random.default_rng(p.seed)
    return {"shared": r.normal(0, width**-0.5, (width, p.hidden)), "bias": np.zeros(p.hidden), "heads": r.normal(0, p.hidden**-0.5, (p.hidden, 2)), "shift": np.zeros(2)}


def forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared layer, return, logit of the direction)."""
    z = np.tanh(x @ w["shared"] + w["bias"])
    out = z @ w["heads"] + w["shift"]
    return z, out[:, 0], out[:, 1]


def loss_and_gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Sums over the rows: squared error of the return plus log loss of the direction, and their gradient. y: (return, direction)."""
    z, value, logit = forward(w, x)
    off = value - y[:, 0]
    loss = float((off**2).sum() + (np.logaddexp(0, logit) - y[:, 1] * logit).sum())
    d = np.column_stack([2 * off, 1 / (1 + np.exp(-logit)) - y[:, 1]])
    dz = (d @ w["heads"].T) * (1 - z**2)
    return loss, {"shared": x.T @ dz, "bias": dz.sum(0), "heads": z.T @ d, "shift": d.sum(0)}


def window_blocks(df: DataFrame, seq: str, value: str, direction: str, sets: dict[str, Column], keys: Sequence[str], scale: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(rows, x, y, id, set): windows of each set in blocks. Returns are less the first of scale, divided by the second. Rows without a label, or with a null or NaN in the window, are left out."""
    flat = F.flatten(seq)
    rows = df.select(flat.alias("x"), ((F.col(value).cast("double") - scale[0]) / scale[1]).alias("v"), F.col(direction).cast("double").alias("d"), F.xxhash64(*keys).alias("id"), F.coalesce(*[F.when(c, F.lit(s)) for s, c in sets.items()]).alias("set"))
    rows = rows.where("v is not null and d is not null and set is not null").where(F.forall("x", lambda x: F.coalesce(~F.isnan(x), F.lit(False))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def shipped(name: str) -> pa.RecordBatch:
            x, y, ids = (np.concatenate(c) for c in zip(*held.pop(name), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (len(y), x.astype(np.float32).tobytes(), y.tobytes(), ids.tobytes(), name)], ["rows", "x", "y", "id", "set"])

        for batch in batches:
            for name in set(batch.column("set").to_pylist()):
                part = batch.filter(pc.equal(batch.column("set"), name))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                held.setdefault(name, []).append((x, np.column_stack([part.column(c).to_numpy() for c in ("v", "d")]), part.column("id").to_numpy()))
                if sum(len(h[2]) for h in held[name]) >= ROWS:
                    yield shipped(name)
        for name in list(held):
            yield shipped(name)

    return _checkpoint(rows.mapInArrow(packed, "rows long, x binary, y binary, id binary, set string"))


def summed(blocks: DataFrame, name: str, w: Weights, gradient: bool, batch: tuple[int, int, int] | None = None) -> tuple[int, float, Weights]:
    """(rows, loss, gradient) over the windows of a set, or over one mini-batch of it: (seed and epoch, number, of how many)."""
    shared = blocks.sparkSession.sparkContext.broadcast(w)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, None
        for b in batches:
            for row in b.to_pylist():
                x, y = np.frombuffer(row["x"], np.float32).reshape(row["rows"], -1), np.frombuffer(row["y"], float).reshape(-1, 2)
                if batch is not None:
                    at = np.flatnonzero((_uniform(np.frombuffer(row["id"], np.int64), batch[0]) * batch[2]).astype(int) == batch[1])
                    x, y = x[at], y[at]
                one, g = loss_and_gradient(shared.value, x.astype(float), y)
                n, loss = n + len(y), loss + one
                if gradient:
                    total = g if total is None else {k: total[k] + g[k] for k in g}
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([pickle.dumps(total)], pa.binary())], ["n", "loss", "g"])

    def added(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, None
        for b in batches:
            for row in b.to_pylist():
                g = pickle.loads(row["g"])
                n, loss = n + row["n"], loss + row["loss"]
                total = g if total is None or g is None else {k: total[k] + g[k] for k in g}
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([pickle.dumps(total)], pa.binary())], ["n", "loss", "g"])

    schema = "n long, loss double, g binary"
    parts = blocks.where(F.col("set") == name).mapInArrow(partial, schema)
    # Sums of some tasks each, so that the driver adds few.
    rows = parts.withColumn("k", F.spark_partition_id() % 16).groupBy("k").applyInArrow(added, schema).collect()
    shared.destroy()
    got = [pickle.loads(r["g"]) for r in rows]
    total = {k: sum(g[k] for g in got) for k in got[0]} if got and gradient else {}
    return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), total


class SequenceNet:
    """Weights of the shared layer and both heads; history: (training loss, validation loss) of each epoch; scale: mean and deviation of returns."""

    def __init__(self, weights: Weights, history: Sequence[tuple[float, float]] = (), scale: tuple[float, float] = (0.0, 1.0)):
        self.weights, self.history, self.scale = weights, list(history), scale

    def transform(self, df: DataFrame, seq: str = "seq") -> DataFrame:
        """Adds predicted_return, probability and prediction; null where the window is null or has a gap."""
        shared, (mean, deviation) = df.sparkSession.sparkContext.broadcast(self.weights), self.scale

        @F.pandas_udf("struct<predicted_return:double,probability:double>")
        def scored(windows):
            import pandas as pd

            w = shared.value
            known = windows.map(lambda v: v is not None and len(v) == len(w["shared"])).to_numpy(bool)
            out = np.full((len(windows), 2), np.nan)
            if known.any():
                _, value, logit = forward(w, np.stack([np.asarray(v, float) for v in windows[known]]))
                out[known] = np.column_stack([value * deviation + mean, 1 / (1 + np.exp(-logit))])
            return pd.DataFrame(out, columns=["predicted_return", "probability"])

        out = df.withColumn("_s", scored(F.flatten(seq)))
        return out.select(*df.columns, *[F.nanvl(F.col(f"_s.{c}"), F.lit(None).cast("double")).alias(c) for c in ("predicted_return", "probability")]).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))

    def save(self, path: str) -> None:
        row = json.dumps({"weights": {k: v.tolist() for k, v in self.weights.items()}, "history": self.history, "scale": self.scale})
        SparkSession.active().createDataFrame([(row,)], "value string").write.mode("overwrite").text(f"{path}/net")

    @classmethod
    def load(cls, path: str) -> SequenceNet:
        row = json.loads(SparkSession.active().read.text(f"{path}/net").first()[0])
        return cls({k: np.array(v) for k, v in row["weights"].items()}, [tuple(h) for h in row["history"]], tuple(row["scale"]))


def fit_sequences(df: DataFrame, train: Column, val: Column, p: NetParams = NetParams(), seq: str = "seq", value: str = "target_return", direction: str = "target_direction", keys: Sequence[str] = ("symbol", "ts")) -> SequenceNet:
    """Trains on the windows where train holds, until those of val get no better. Without training windows the first weights stay.

    Returns are scaled by their mean and deviation over the training windows, so that both heads weigh alike.
    """
    mean, deviation = df.where(train).agg(F.avg(value), F.stddev_pop(value)).first()
    scale = (mean or 0.0, deviation or 1.0)
    blocks = window_blocks(df, seq, value, direction, {"train": train, "val": val}, keys, scale)
    first = blocks.select(F.octet_length("x").alias("x"), "rows").first()
    w = first_weights(first["x"] // 4 // first["rows"] if first else 1, p)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    best, least, waited, step, history = w, np.inf, 0, 0, []
    for epoch in range(p.epochs):
        loss, rows = 0.0, 0
        for k in range(p.batches):
            n, one, g = summed(blocks, "train", w, True, (p.seed * 1000 + epoch, k, p.batches))
            if not n:
                continue
            step, loss, rows = step + 1, loss + one, rows + n
            g = {c: x / n + p.ridge * w[c] for c, x in g.items()}
            m, v = {c: 0.9 * m[c] + 0.1 * g[c] for c in g}, {c: 0.999 * v[c] + 0.001 * g[c] ** 2 for c in g}
            w = {c: w[c] - p.rate * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-8) for c in g}
        if not rows:
            break
        n, held, _ = summed(blocks, "val", w, False)
        told = held / n if n else loss / rows
        history.append((loss / rows, told))
        waited = waited + 1 if told >= least else 0
        if told < least:
            best, least = w, told
        if waited >= p.patience:
            break
    return SequenceNet(best, history, scale)
