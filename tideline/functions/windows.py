"""Window primitives. Every window is keyed; a value needs its whole window (else null)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.schema import KEYS, ORDER

#: An exponential mean's chunk: weights fade by exp(-FADE) in it.
FADE = 100.0
#: Rows of a range, or of a chunk of one long series: what a task sorts at once.
RANGE_ROWS = 1_000_000


def series(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where b is zero, also in ANSI mode."""
    return F.try_divide(a, b)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def clean(c: Column) -> Column:
    """NaN becomes null, the one mark of a missing value."""
    return F.when(~F.isnan(c), c)


def lag_(c: Column, k: int, w: WindowSpec) -> Column:
    return F.lag(c, k).over(w)


def lead_(c: Column, k: int, w: WindowSpec) -> Column:
    return F.lead(c, k).over(w)


def _full(agg: Column, c: Column, size: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(1 - size, 0)
    return F.when(F.count(c).over(frame) == size, agg.over(frame))


def rolling_mean(c: Column, size: int, w: WindowSpec) -> Column:
    return _full(F.avg(c), c, size, w)


def rolling_std(c: Column, size: int, w: WindowSpec) -> Column:
    return _full(F.stddev_samp(c), c, size, w)


def rolling_min(c: Column, size: int, w: WindowSpec) -> Column:
    return _full(F.min(c), c, size, w)


def rolling_max(c: Column, size: int, w: WindowSpec) -> Column:
    return _full(F.max(c), c, size, w)


def ffill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def diff(c: Column, w: WindowSpec) -> Column:
    return c - lag_(c, 1, w)


def pct_change(c: Column, k: int, w: WindowSpec) -> Column:
    return safe_div(c, lag_(c, k, w)) - 1


def with_position(df: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Adds pos (from 1) and n (rows of the key)."""
    return df.withColumn("pos", F.row_number().over(series(keys, order))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def alpha_of(com: float | None = None, span: float | None = None) -> float:
    return 1 / (1 + com) if com is not None else 2 / (span + 1)


def with_ewm(df: DataFrame, columns: dict[str, tuple[str, float]], keys: Sequence[str] = KEYS, order: str = ORDER, kept: dict[str, str] | None = None) -> DataFrame:
    """Adds exponential means out: (column, alpha) with y0 = x0, y = d * y + (1 - d) * x.

    d is 1 - alpha; g rows after the last value it is r / (r + alpha) with r = (1 - alpha) ** g, so a
    gap lets the old mean fade. Leading nulls give null; a null later on carries the last mean. The
    recursion is written in closed form over chunks in which the weights fade by exp(-FADE), so that
    what came before the previous chunk is below double precision: a running sum in each chunk, and
    the previous chunk's last value carried in. All columns share each of the four passes.
    kept names, for some of the outs, columns with the weight that the key's first value has left.
    """
    w = series(keys, order)
    past, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    names = list(columns)
    x = {n: F.col(c) for n, (c, _) in columns.items()}
    at = F.row_number().over(w)
    out = df.withColumn("_at", at)
    out = out.withColumns({f"_g_{n}": F.when(x[n].isNotNull(), F.col("_at") - F.last(F.when(x[n].isNotNull(), F.col("_at")), True).over(before)) for n in names})
    # One minus d: all of it for the first value.
    out = out.withColumns({f"_w_{n}": F.when(x[n].isNotNull(), F.when(F.col(f"_g_{n}").isNull(), 1.0).when(F.col(f"_g_{n}") == 1, alpha).otherwise(alpha / (F.pow(F.lit(1 - alpha), F.col(f"_g_{n}")) + alpha))) for n, (_, alpha) in columns.items()})
    out = out.withColumns({f"_l_{n}": F.sum(F.when(F.col(f"_w_{n}") < 1, F.ln(1 - F.col(f"_w_{n}"))).otherwise(F.when(F.col(f"_g_{n}").isNotNull(), -10.0 * FADE).otherwise(0.0))).over(past) for n in names})
    out = out.withColumns({f"_c_{n}": F.floor(-F.col(f"_l_{n}") / FADE) for n in names})

    def chunk(n: str):
        return Window.partitionBy(*keys, f"_c_{n}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    rest = {n: F.col(f"_l_{n}") + FADE * F.col(f"_c_{n}") for n in names}
    out = out.withColumns({f"_y_{n}": F.exp(rest[n]) * F.sum(F.col(f"_w_{n}") * x[n] * F.exp(-rest[n])).over(chunk(n)) for n in names})
    ends = {f"_e_{n}": F.when(F.lead(f"_c_{n}").over(w) > F.col(f"_c_{n}"), F.struct(f"_y_{n}", f"_l_{n}")) for n in names}
    out = out.withColumns(ends).withColumns({f"_e_{n}": F.last(f"_e_{n}", True).over(before) for n in names})
    carried = {n: F.coalesce(F.exp(F.col(f"_l_{n}") - F.col(f"_e_{n}")[f"_l_{n}"]) * F.col(f"_e_{n}")[f"_y_{n}"], F.lit(0.0)) for n in names}
    out = out.withColumns({n: F.coalesce(F.col(f"_y_{n}"), F.when(F.col(f"_e_{n}").isNotNull(), 0.0)) + carried[n] for n in names})
    out = out.withColumns({p: F.exp(F.col(f"_l_{n}")) for n, p in (kept or {}).items()})
    return out.drop("_at", *[f"_{k}_{n}" for k in "gwlcye" for n in names])


def in_ranges(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with _part: the number of the range of order that a row lies in. A range has about so many rows, so ranges grow with the table.

    Equal values share a range; null is in the first one. A table of one range is counted, but not read for its quantiles.
    """
    kind = df.schema[order].dataType.typeName()
    value = F.unix_micros(F.col(order).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(order)
    parts = -(-df.count() // rows)
    cuts = sorted(set(df.select(value.cast("double").alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    if not cuts:
        return df.withColumn("_part", F.lit(0))
    # A binary search by halves: as many comparisons as the cuts have digits, not cuts.
    place, step = F.lit(0), 1 << (len(cuts).bit_length() - 1)
    table = F.array(*map(F.lit, cuts))
    while step:
        there = F.get(table, place + (step - 1))
        place = place + F.when(there < value, F.lit(step)).otherwise(F.lit(0))
        step //= 2
    return df.withColumn("_part", place)


def with_running(df: DataFrame, sums: dict[str, Column], keys: Sequence[str], order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds sums over all earlier rows of a key (0 for its first), with no key in one task.

    Rows are dealt by ranges of the order; a range adds the sums of the ranges before it, of which a key has one a `rows` rows.
    """
    dealt = in_ranges(df, order, rows)
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    whole = whole.select(*keys, "_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(whole, [*keys, "_part"])
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def chunks(df: DataFrame, halo: int, ahead: int = 0, keys: Sequence[str] = KEYS, order: str = ORDER, rows: int = RANGE_ROWS) -> DataFrame:
    """df with _at (a row's place in its key, from 0), _chunk and _own: a key's rows in chunks of so many rows, each with the halo rows before and the ahead rows after it.

    A row is in its own chunk (_own), and copied to the next (previous) one where it is in that one's halo. order is unique within a key.
    """
    rows = max(rows, halo, ahead, 1)
    placed = with_running(df, {"_at": F.lit(1)}, keys, order, rows)
    own, inside = F.floor(F.col("_at") / rows), F.col("_at") % rows
    copies = F.filter(F.array(own, F.when(inside >= rows - halo, own + 1), F.when((inside < ahead) & (own > 0), own - 1)), lambda c: c.isNotNull())
    return placed.withColumn("_home", own).withColumn("_chunk", F.explode(copies)).withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")


def by_chunks(df: DataFrame, build: Callable[[DataFrame, tuple[str, ...]], DataFrame], halo: int, ahead: int = 0, keys: Sequence[str] = KEYS, order: str = ORDER, rows: int = RANGE_ROWS) -> DataFrame:
    """build(df, keys) for keys with any number of rows: it runs chunk by chunk, so one long series takes all cores.

    build's columns at a row depend on halo rows before and ahead rows after it at most, and it keeps keys and order. Exponential
    means fade below double precision in a halo of 40 / alpha rows; with_ewm_ranges has them without a halo.
    """
    dealt = chunks(df, halo, ahead, keys, order, rows)
    inner = (*keys, "_chunk")
    ends = dealt.where("_own").groupBy(*inner).agg(F.min(order).alias("_from"), F.max(order).alias("_to"))
    out = build(dealt.drop("_own", "_at"), inner).join(ends, list(inner))
    return out.where(F.col(order).between(F.col("_from"), F.col("_to"))).drop("_chunk", "_from", "_to")


def with_ewm_ranges(df: DataFrame, columns: dict[str, tuple[str, float]], keys: Sequence[str] = KEYS, order: str = ORDER, rows: int = RANGE_ROWS) -> DataFrame:
    """with_ewm for keys with any number of rows, by a scan of affine maps.

    A chunk's first value y turns its row i into P y + Q, where P is the product of the weights of what came before and Q the mean
    that starts at 0. So a chunk is one map from the last mean before it to its own last one; the maps of a key, a row a
    chunk, are applied one after the other, and each row adds P times what its chunk's first mean had left out.
    """
    names, inner = list(columns), (*keys, "_chunk")
    dealt = chunks(df, 0, 0, keys, order, rows).drop("_own").withColumnRenamed("_at", "_row")
    local = with_ewm(dealt, {f"_y_{n}": c for n, c in columns.items()}, inner, order, kept={f"_y_{n}": f"_p_{n}" for n in names})
    last = lambda c, n: F.max_by(c, F.when(F.col(columns[n][0]).isNotNull(), F.col("_row")))
    at = lambda n: F.when(F.col(columns[n][0]).isNotNull(), F.col("_row"))
    ends = local.groupBy(*inner).agg(*[F.struct(F.min(at(n)).alias("first"), F.max(at(n)).alias("last"), F.min_by(columns[n][0], at(n)).cast("double").alias("x"), last(f"_y_{n}", n).alias("y"), last(f"_p_{n}", n).alias("p")).alias(n) for n in names])
    kinds = dict(df.dtypes)
    out_type = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_chunk long", *(f"`_o_{n}` double, `_b_{n}` double" for n in names)])

    def scan(pdf):
        pdf = pdf.sort_values("_chunk")
        out = pdf[[*keys, "_chunk"]].copy()
        for n in names:
            alpha, mean, seen, off, base = columns[n][1], None, 0, [], []
            for m in pdf[n]:
                base.append(mean)
                if m["first"] is None or m["first"] != m["first"]:
                    off.append(None)
                    continue
                fade = (1 - alpha) ** (m["first"] - seen)
                start = m["x"] if mean is None else (fade * mean + alpha * m["x"]) / (fade + alpha)
                off.append(start - m["x"])
                mean, seen = m["y"] + m["p"] * (start - m["x"]), m["last"]
            out[f"_o_{n}"], out[f"_b_{n}"] = off, base
        return out

    maps = ends.groupBy(*keys).applyInPandas(scan, out_type)
    both = local.join(maps, list(inner))
    # Before a chunk's first value the mean of the chunk before it holds.
    done = {n: F.coalesce(F.col(f"_y_{n}") + F.col(f"_p_{n}") * F.col(f"_o_{n}"), F.col(f"_b_{n}")) for n in names}
    return both.withColumns(done).drop("_chunk", "_row", *[f"{k}{n}" for k in ("_y_", "_p_", "_o_", "_b_") for n in names])
