"""Operator 7: nearest neighbours with a vantage-point tree for each shard.

Geometry. Vectors are scaled by the largest norm, and one more coordinate puts them on the unit sphere;
queries are scaled onto it as well. Largest inner product then is smallest Euclidean distance, and
the triangle inequality holds. Before that all vectors of a dimension are divided by a power of two, and each
vector's own products are made with its mantissas: no norm or product over- or underflows on the way to a score.

Shards. A bounded sample of the vectors are pivots. Every vector is in the cell of its nearest pivot,
and large cells are cut into shards of bounded size by a hash. A shard's vantage-point tree is built
in one task.

Search. A query meets the trees of its nearest pivot's cell first; its k-th best score there is its
bound. It then meets the other cells that may hold a nearer vector: those whose lower bound on the
distance (by the cell's pivot and its least and largest radius, and by the plane between pivots),
times factor, is below the bound's distance. In a tree a branch is skipped on the same terms, by the
rings around its vantage points and the ball around its middle. Factor 1
is exact, more skips more. Only the (query, shard) pairs that are left travel, in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, skew_join, tune

SHARD_ROWS, BLOCK_QUERIES, LEAF = 4096, 2048, 64
#: Pivots at most: their vectors and radii go to every task, some MB.
PIVOTS = 1024
#: Found by measuring recall on the test tables (see the README).
FACTOR = 1.15
#: Scores this close to a bound are computed once more by a sum in a fixed order, which ranks them.
SLACK = 1e-9


def mantissas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector divided by a power of two so that its components are below 1, and the exponents."""
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1].astype(np.int64)
    return np.ldexp(x, -exponent[:, None]), exponent


def raised(x: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """x times 2 ** exponent; infinite, or 0, where that is beyond doubles."""
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(x, np.clip(exponent, -4000, 4000).astype(np.int32))


def in_units(score: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """A bound on the products, divided by 2 ** exponent, of vectors that score as much: scores beyond doubles are all alike."""
    most = np.finfo(float).max
    return np.where(score == -np.inf, -np.inf, raised(np.clip(score, -most, most), -exponent))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors of norm up to most, on the unit sphere with one more coordinate."""
    x = x / most
    return np.column_stack([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))])


def build_tree(ids: np.ndarray, x: np.ndarray, most: float, leaf: int = LEAF, unit: int = 0) -> tuple:
    """(ids, mantissas, their exponents less unit, most, unit, nodes): rows in tree order. most: the largest norm divided by 2 ** unit.

    A node is (begin, end, middle, radius, vantage vector, least and largest distances of both halves,
    left, right); leaves have no vantage vector.
    """
    x, exponent = mantissas(x)
    full = lifted(raised(x, exponent[:, None] - unit), most)
    order, nodes = np.arange(len(x)), []

    def grow(begin: int, end: int) -> int:
        k, rows = len(nodes), order[begin:end]
        middle = full[rows].mean(0)
        ball = middle, float(np.sqrt(((full[rows] - middle) ** 2).sum(1).max()))
        nodes.append((begin, end, *ball, None, (), -1, -1))
        if end - begin > leaf:
            # The row that is furthest from the first one: its distances spread most.
            v = full[rows[int((full[rows] @ full[rows[0]]).argmin())]]
            d = np.sqrt(np.maximum(2 - 2 * (full[rows] @ v), 0))
            by = np.argsort(d, kind="stable")
            order[begin:end], d = rows[by], d[by]
            mid = (end - begin) // 2
            left, right = grow(begin, begin + mid), grow(begin + mid, end)
            nodes[k] = (begin, end, *ball, v, (d[0], d[mid - 1], d[mid], d[-1]), left, right)
        return k

    grow(0, len(x))
    return ids[order], x[order], exponent[order] - unit, most, unit, nodes


def search_tree(tree: tuple, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, id) of each query, ties to the smaller id, and how many vectors were scored; a query's own id takes no part.

    bound: a score that the k-th best reaches at least (-inf: none known); lower ones need not be found.
    """
    ids, x, exponent, most, unit, nodes = tree
    q, own = mantissas(q)
    # Products of mantissas and of vectors in units are scores divided by 2 ** power.
    power = own + unit
    score, best = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    count, size = np.zeros(len(q), np.int64), np.sqrt(np.einsum("ij,ij->i", q, q))
    unit = np.column_stack([q / size[:, None], np.zeros(len(q))])
    # The last term: products that differ by less than the least double score the same.
    slack = SLACK * size * most + raised(np.full(len(q), 1e-323), -power)
    # Powers that no product of doubles can carry beyond them are plain factors.
    plain = bool((np.abs(power) < 500).all())
    factors, scaled = raised(np.ones(len(q)), -power), raised(x, exponent[:, None])

    def floor(rows: np.ndarray) -> np.ndarray:
        """The product from which on a vector still counts."""
        least = np.maximum(score[rows, -1], bound[rows])
        return (least * factors[rows] if plain else in_units(least, power[rows])) - slack[rows]

    def far(rows: np.ndarray) -> np.ndarray:
        """Distance within which a query still looks."""
        least = floor(rows)
        return np.sqrt(np.maximum(2 - 2 * least / (size[rows] * most), 0))

    # A stack of (node, queries, their lower bounds on the distance); the nearer half is on top.
    stack = [(0, np.arange(len(q)), np.zeros(len(q)))]
    while stack:
        node, rows, low = stack.pop()
        begin, end, middle, radius, v, rings, left, right = nodes[node]
        use = factor * low <= far(rows)
        rows, low = rows[use], low[use]
        low = np.maximum(low, np.sqrt(np.maximum(1 + middle @ middle - 2 * (unit[rows] @ middle), 0)) - radius)
        use = factor * low <= far(rows)
        rows, low = rows[use], low[use]
        if not len(rows):
            continue
        if v is None:
            s = q[rows] @ scaled[begin:end].T
            s[ids[begin:end] == query_ids[rows][:, None]] = -np.inf
            count[rows] += end - begin
            i, j = np.nonzero(s >= np.maximum(floor(rows), -np.finfo(float).max)[:, None])
            if len(i):
                exact = np.full(s.shape, -np.inf)
                exact[i, j] = raised(np.einsum("ij,ij->i", q[rows[i]], x[begin + j]), power[rows[i]] + exponent[begin + j])
                s, i = np.hstack([score[rows], exact]), np.hstack([best[rows], np.broadcast_to(ids[begin:end], s.shape)])
                by = np.lexsort((i, -s), axis=-1)[:, :k]
                score[rows], best[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
            continue
        d = np.sqrt(np.maximum(2 - 2 * (unit[rows] @ v), 0))
        near = d <= (rings[1] + rings[2]) / 2
        a, b = np.maximum(rings[0] - d, d - rings[1]), np.maximum(rings[2] - d, d - rings[3])
        for child, low_, use in ((right, b, near), (left, a, ~near), (right, b, ~near), (left, a, near)):
            if use.any():
                stack.append((child, rows[use], np.maximum(low_[use], low[use])))
    return score, best, count


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score, n_scored): each query's k nearest of vectors by inner product in double precision.

    Nearest first, ties to the smaller id, all candidates where there are fewer than k. A product that is
    beyond doubles scores infinity, one that is below them 0, and such ones are ties. Rows with a
    null id, or a vector that is null, empty, zero or holds null or non-finite components, take no
    part on either side; only vectors of a query's own dimension are its candidates. Rows that repeat
    an id count once (the greatest vector, in array order). Extra columns are ignored. An empty table
    gives an empty result. n_scored: with how many vectors the query was multiplied.
    """
    spark = vectors.sparkSession
    tune(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
        v = v.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
        return v.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 1))

    rows, asked = checkpoint(clean(vectors)), checkpoint(clean(queries))
    largest = rows.groupBy("dim").agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most")).collect()
    units = {r.dim: int(np.frexp(r.most)[1]) for r in largest}
    # Two factors: one power of two may be beyond doubles.
    half = {d: (2.0 ** (-e // 2), 2.0 ** (-e - -e // 2)) for d, e in units.items()}
    scale = F.create_map(*[x for d, (a, b) in half.items() for x in (F.lit(d), F.array(F.lit(a), F.lit(b)))]) if half else F.create_map()
    scale = scale[F.col("dim")] if half else F.array(F.lit(1.0), F.lit(1.0))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * scale[0] * scale[1]), F.lit(0.0), lambda a, x: a + x * x))
    most = {r.dim: r.most for r in rows.groupBy("dim").agg(F.max(norm).alias("most")).collect()}
    wanted = min(pivots, -(-rows.count() // shard_rows))
    picked: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(wanted).collect():
        picked.setdefault(r.dim, []).append(r.v)
    # A dimension without a pivot is one cell around the first axis.
    centres = {d: lifted(raised(np.array(picked[d]), -units[d]) if d in picked else np.array([[m] + [0.0] * (d - 1)]), m) for d, m in most.items()}
    index = spark.sparkContext.broadcast((most, centres, units))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, centres, units = index.value
        for batch in batches:
            dims, cell, radius = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                dot = lifted(raised(matrix(batch.column("v").take(pa.array(at))), -units[d]), most[d]) @ centres[d].T
                cell[at] = dot.argmax(1)
                radius[at] = np.sqrt(np.maximum(2 - 2 * dot.max(1), 0))
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(cell), pa.array(radius), batch.column("id"), batch.column("v")], ["dim", "cell", "radius", "id", "v"])

    homes = checkpoint(rows.select("dim", "id", "v").mapInArrow(placed, "dim int, cell int, radius double, id long, v array<double>"))
    # One row a cell: as many as pivots at most, and one for each dimension without.
    cells = homes.groupBy("dim", "cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shards = {(r.dim, r.cell): (r.low, r.high, r.shards) for r in cells.collect()}
    split = F.broadcast(spark.createDataFrame([(d, c, s) for (d, c), (_, _, s) in shards.items()], "dim int, cell int, shards int"))

    def planted(table: pa.Table) -> pa.Table:
        order, d = table.sort_by("id"), table.column("dim")[0].as_py()
        tree = build_tree(order.column("id").to_numpy(), matrix(order.column("v")), index.value[0][d], unit=index.value[2][d])
        return pa.table({"dim": order.column("dim")[:1], "cell": order.column("cell")[:1], "shard": order.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = homes.join(split, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).select("dim", "cell", "shard", "id", "v")
    trees = checkpoint(trees.groupBy("dim", "cell", "shard").applyInArrow(planted, "dim int, cell int, shard int, tree binary"))
    where = spark.sparkContext.broadcast(shards)

    def routed(first: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (most, centres, units), shards = index.value, where.value
            for batch in batches:
                dims, q_row, q_cell, q_shard = batch.column("dim").to_numpy(), [], [], []
                bounds = batch.column("bound").to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in most:
                        continue
                    at = np.flatnonzero(dims == d)
                    q, own = mantissas(matrix(batch.column("v").take(pa.array(at))))
                    power = own + units[d]
                    size = np.sqrt(np.einsum("ij,ij->i", q, q))
                    dot = np.column_stack([q / size[:, None], np.zeros(len(q))]) @ centres[d].T
                    dist = np.sqrt(np.maximum(2 - 2 * dot, 0))
                    info = [shards.get((d, c)) for c in range(len(centres[d]))]
                    full = np.array([x is not None for x in info])
                    home = np.where(full, dot, -np.inf).argmax(1)
                    go = np.zeros(dist.shape, bool)
                    go[np.arange(len(q)), home] = True
                    if not first:
                        ring = np.array([x[:2] if x else (0.0, 0.0) for x in info])
                        low = np.maximum(np.maximum(ring[:, 0] - dist, dist - ring[:, 1]), 0)
                        # Vectors of a cell are nearer to its pivot than to the query's.
                        apart = np.sqrt(np.maximum(2 - 2 * (centres[d][home] @ centres[d].T), 0))
                        plane = (dist**2 - dist[np.arange(len(q)), home][:, None] ** 2) / np.maximum(2 * apart, 1e-12)
                        low = np.maximum(low, np.where(apart > 1e-9, plane, 0))
                        least = in_units(bounds[at], power) - raised(np.full(len(at), 1e-323), -power)
                        far = np.sqrt(np.maximum(2 - 2 * (least / (size * most[d]) - SLACK), 0))
                        go = ~go & full & (factor * low <= far[:, None])
                    for i, c in zip(*(x.tolist() for x in np.nonzero(go)), strict=True):
                        for s in range(info[c][2]):
                            q_row.append(at[i])
                            q_cell.append(c)
                            q_shard.append(s)
                take = pa.array(np.array(q_row, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("dim").take(take), pa.array(q_cell, pa.int32()), pa.array(q_shard, pa.int32()), batch.column("id").take(take), batch.column("v").take(take), batch.column("bound").take(take)], ["dim", "cell", "shard", "id", "v", "bound"])

        return route

    near_type = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64()), ("score", pa.float64())]))

    def searched(trees: pa.Table, asked: pa.Table) -> pa.Table:
        ids, near, count = np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        if trees.num_rows and asked.num_rows:
            ids = asked.column("id").to_numpy()
            score, best, count = search_tree(pickle.loads(trees.column("tree")[0].as_py()), ids, matrix(asked.column("v")), asked.column("bound").to_numpy(), k, factor)
            near = [[{"far": -x, "id": y, "score": x} for x, y in zip(s.tolist(), b.tolist(), strict=True) if x > -np.inf] for s, b in zip(score, best, strict=True)]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "near": pa.array(near, near_type), "n": pa.array(count, pa.int64())})

    def met(asked: DataFrame, first: bool) -> DataFrame:
        """(query_id, near, n): the k best of the shards that each query meets."""
        keys = ["dim", "cell", "shard"]
        pairs = checkpoint(asked.select("dim", "id", "v", "bound").mapInArrow(routed(first), "dim int, cell int, shard int, id long, v array<double>, bound double"))
        blocks = pairs.groupBy(*keys).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
        blocks = checkpoint(blocks)
        pairs = skew_join(pairs, blocks, keys).select(*keys, F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), "id", "v", "bound")
        used = trees.join(blocks.toDF(*keys, "n"), keys).select(*keys, "tree", F.explode(F.expr("sequence(0, n - 1)")).alias("block"))
        keys.append("block")
        found = used.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(searched, "query_id long, near array<struct<far:double,id:long,score:double>>, n long")
        return _merged(found, k)

    start = met(asked.withColumn("bound", F.lit(float("-inf"))), True)
    start = checkpoint(start)
    known = F.when(F.size("near") >= k, F.element_at("near", k)["score"]).otherwise(F.lit(float("-inf")))
    again = asked.join(start.select(F.col("query_id").alias("id"), known.alias("bound")), "id")
    best = _merged(start.unionAll(met(again, False)), k)
    out = best.select("query_id", "n", F.posexplode("near").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"), F.col("n").alias("n_scored"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's lists, which hold k at most; a query has one list a shard."""
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("n").alias("n"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
