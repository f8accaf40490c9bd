"""Operator 10: exact n-gram Jaccard join with a token-group matrix.

Sets. Each text becomes its set of hashed word shingles. Equal sets collapse into one class, so
copies cost one row. A count of all shingles in a table of fixed size gives one global order, rarest
first; a set's prefix in that order has its size, less the least overlap, plus a bound (a SHARE-th of
the set). Two sets that link share at least the smaller of their bounds among their prefixes. The
counts decide only the order, and so the speed: any order gives the same links.

Representatives. Each prefix shingle names the smallest class that has it, and a class has the one that
most of its shingles name for its representative. The two are compared at once if that many shingles
make a link likely. What links with the
same representative is one core: its members need not be compared with each other any more, so a
large family of near copies costs a row a member.

Groups. A core is a group; classes that don't link with their representative are a group with it, and
with the one that it has in turn. Large groups are cut into chunks by a hash, so that none grows with
the data.

Matrix. (shingle, group) for the prefix shingles of all members is each group's token union (of
prefixes, not of whole sets: the bound above is on what prefixes share). The overlap of a query set
with a union bounds its overlap with any member, so a group is opened for a query only if it shares
the bound of its possible partners. An opened group's members are indexed once, queries stream past
in blocks, and overlaps are counted on the sets of whole texts. Links between texts that are
connected within a block already are left out, as they change no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, components, matched, mix, skew_join, text_bytes, text_slices, tune, window_hashes, without, word_hashes

#: Prefix shingles that linked sets must share: a SHARE-th of the smaller set, LEAST at least.
SHARE, LEAST = 20, 2
#: Counters of the shingle table (4 bytes each), in blocks.
SLOTS, BLOCK = 1 << 20, 1 << 15
SLICE = 2 << 20
#: Members of a group's chunk, queries that meet it in one block, and those that meet a representative.
CHUNK, QUERIES, FOLLOWERS = 256, 512, 256


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of each text's distinct shingles, sorted; a text with fewer words is one shingle."""
    words, text = word_hashes(*text_bytes(column), lower=True)
    count = np.bincount(text, minlength=len(column))
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size in range(1, width + 1):
        h = window_hashes(words, size)
        if len(h):
            inside = text[: len(h)] == text[size - 1 :]
            inside &= count[text[: len(h)]] >= width if size == width else count[text[: len(h)]] == size
            hashes.append(h[inside] ^ np.uint64(width - size))
            owner.append(text[: len(h)][inside])
    h, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _bound(n: str) -> str:
    return f"greatest({LEAST}, ({n}) div {SHARE})"


def _rarity(docs: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle in each slot; summed by Spark block by block, a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in text_slices(batches, SLICE):
            n += np.bincount((shingle_sets(batch.column("text"), width)[1] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        blocks = [k for k in range(SLOTS // BLOCK) if n[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([pa.compress(n[k * BLOCK : (k + 1) * BLOCK].astype(np.uint32).tobytes(), "zstd", asbytes=True) for k in blocks], pa.binary())], ["block", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        n = np.zeros(BLOCK, np.int64)
        for x in table.column("counts").to_pylist():
            n += np.frombuffer(pa.decompress(x, 4 * BLOCK, "zstd"), np.uint32)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros(SLOTS, np.uint32)
    for row in docs.select("text").mapInArrow(counted, "block int, counts binary").groupBy("block").applyInArrow(summed, "block int, counts binary").collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.uint32)
    return out


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, prefix): size, 128-bit key and prefix of each set; no key where it is empty."""
    table = docs.sparkSession.sparkContext.broadcast(_rarity(docs, width))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = table.value
        for batch in text_slices(batches, SLICE):
            owner, h = shingle_sets(batch.column("text"), width)
            n = np.bincount(owner, minlength=batch.num_rows)
            begin = np.cumsum(n) - n
            keys = []
            for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
                run = np.append(np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64))
                keys.append(pa.array((run[begin + n] - run[begin]).view(np.int64), mask=n == 0))
            size = n - -(-percent * n // 100) + np.maximum(n // SHARE, LEAST)
            size = np.where(n * (100 - percent) >= percent, np.minimum(size, n), 0)
            order = np.lexsort((h, count[(h & np.uint64(SLOTS - 1)).astype(np.int64)], owner))
            place = np.arange(len(h)) - begin[owner]
            prefix = h[order][place < size[owner]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(prefix))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *keys, lists], ["id", "n", "k1", "k2", "prefix"])

    return docs.mapInArrow(made, "id long, n long, k1 long, k2 long, prefix array<long>")


def _links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) from rows (home, chunk, block, query, id, text) that hold each group's members, then its queries."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, texts, index, parent = None, [], [], None, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("home", "chunk", "block")), strict=True))
            asks, ids = batch.column("query").to_pylist(), batch.column("id").to_pylist()
            text = batch.column("text")
            asked = np.flatnonzero(asks)
            owner, h = shingle_sets(text.take(pa.array(asked)), width)
            cut = dict(zip(asked.tolist(), np.searchsorted(owner, np.arange(len(asked))).tolist(), strict=True))
            end = dict(zip(asked.tolist(), np.searchsorted(owner, np.arange(len(asked)), "right").tolist(), strict=True))
            found: list[tuple[int, int]] = []
            for k, key in enumerate(keys):
                if key != now:
                    now, names, texts, index, parent = key, [], [], None, {}
                if not asks[k]:
                    names.append(ids[k])
                    texts.append(text[k].as_py())
                    continue
                if index is None:
                    mo, mh = shingle_sets(pa.array(texts, pa.string()), width)
                    by = np.argsort(mh, kind="stable")
                    index, sizes, texts = (mh[by], mo[by]), np.bincount(mo, minlength=len(names)), []
                q = h[cut[k] : end[k]]
                low, high = np.searchsorted(index[0], q), np.searchsorted(index[0], q, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(index[1][at], minlength=len(names))
                for m in np.flatnonzero(100 * both >= percent * (len(q) + sizes - both)).tolist():
                    x, y = root(ids[k]), root(names[m])
                    if x != y:
                        parent[x] = y
                        found.append((ids[k], names[m]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    keys = ["home", "chunk", "block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "query").mapInArrow(opened, "a long, b long").distinct()


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (id) with their texts; only texts that a row asks for are shuffled."""
    rows = checkpoint(rows)
    return skew_join(rows, matched(texts, rows.select("id"), ["id"])[1], ["id"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among pairs (id, home) of a class and its representative, which is shipped once for each FOLLOWERS of its classes."""
    sizes = pairs.groupBy("home").agg(F.ceil(F.count("*") / FOLLOWERS).alias("blocks"))
    queries = skew_join(pairs, sizes, ["home"]).select("home", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(True).alias("query"), "id")
    members = sizes.select("home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), F.col("home").alias("id"))
    return _links(_with_texts(queries.unionAll(members).withColumn("chunk", F.lit(0).cast("long")), texts), width, percent)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): one row per input row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct
    shingles of width words, or the whole sequence where there are fewer. Two documents link when
    100 * intersection >= percent * union; component_id is the smallest id reachable. A text that is
    null or has no words has an empty set and links with nothing; rows with a null id take no part
    and have a null component; rows that repeat an id and text are alike.
    """
    tune(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text")
    sets = checkpoint(_sets(rows, width, percent))
    texts = rows.where("id is not null")
    reps = sets.where("id is not null and k1 is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    prefixes = sets.where("size(prefix) > 0").join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    tokens = prefixes.select("id", "n", F.explode("prefix").alias("token"))
    alike = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"

    shared = tokens.groupBy("token").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1").selectExpr("token", "hub.id hub", "hub.n hub_n")
    tokens = checkpoint(skew_join(tokens, shared, ["token"]))
    stars = tokens.where(f"id <> hub and {alike}").groupBy("id", "hub").agg(F.count("*").alias("m"), F.first(F.expr("least(n, hub_n)")).alias("low"))
    least = stars.groupBy("id").agg(F.max(F.struct("m", (-F.col("hub")).alias("hub"), "low")).alias("best"))
    least = checkpoint(least.select("id", (-F.col("best.hub")).alias("home"), F.expr(f"best.m >= {_bound('best.low')}").alias("likely")))

    near = checkpoint(_verified(least.where("likely").select("id", "home"), texts, width, percent))
    core = near.select(F.col("a").alias("id"), F.col("b").alias("core"))
    heads = core.select("core").distinct().selectExpr("core id", "core head")
    homes = skew_join(tokens.select("id", "n").distinct(), least.select("id", "home"), ["id"], "left")
    homes = skew_join(homes, core, ["id"], "left")
    homes = skew_join(homes, heads, ["id"], "left")
    homes = skew_join(homes, least.selectExpr("id home", "home next"), ["home"], "left")
    homes = homes.selectExpr("id", "n", "coalesce(core, head) is not null as linked", "coalesce(core, head, next, home, id) as home")
    sizes = homes.groupBy("home", "linked").agg(F.count("*").alias("size"))
    groups = checkpoint(skew_join(homes, sizes, ["home", "linked"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK)) * 2 + F.col("linked").cast("int")).drop("linked"))

    # A core's chunks have odd numbers. Each of two groups is opened by the lower one's members.
    placed = skew_join(tokens.select("token", "id"), groups, ["id"])
    unions = placed.groupBy("token", F.col("home").alias("to"), F.col("chunk").alias("part")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    mine = "(home = to and (chunk % 2 = 0 and (part % 2 = 1 or chunk < part or chunk = part and size > 1)))"
    bounds = skew_join(placed, unions, ["token"]).where(f"(home < to or {mine}) and {percent} * low <= 100 * n and 100 * high >= {percent} * n")
    asked = checkpoint(bounds.groupBy("id", "n", "to", "part").agg(F.count("*").alias("m")).where(f"m >= {_bound(f'{percent} * n div 100')}").selectExpr("id", "to home", "part chunk"))
    blocks = asked.groupBy("home", "chunk").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    queries = skew_join(asked, blocks, ["home", "chunk"]).select("home", "chunk", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(True).alias("query"), "id")
    members = skew_join(groups, blocks, ["home", "chunk"]).select("home", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), "id")
    linked = components(near.unionAll(_links(_with_texts(queries.unionAll(members), texts), width, percent)))

    classes = skew_join(sets, reps, ["k1", "k2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = skew_join(classes, linked.withColumnRenamed("id", "rep"), ["rep"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that link, directly or not, to one with a smaller id; all columns stay.

    A text links for itself, whatever other texts have its id; rows with a null id all stay, and so
    do texts that are null or have no words. Where an id has several texts, rows are told by a hash
    of id and text (ids themselves take less space). An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.where("id is not null").withColumn("row", F.xxhash64("id", "text"))
    if named.groupBy("id").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").isEmpty():
        gone = jaccard_components(rows, "id", "text", width, percent).where("id <> component_id").select("id")
        return without(docs, gone, id=F.col(id_col).cast("long"))
    parts = jaccard_components(named, "row", "text", width, percent).select("row", "component_id").distinct()
    linked = checkpoint(skew_join(named.select("id", "row").distinct(), parts, ["row"]))
    least = linked.groupBy("component_id").agg(F.min("id").alias("least"))
    gone = skew_join(linked, least, ["component_id"]).where("id > least").select("id", "row")
    key = F.col(id_col).cast("long")
    return without(docs, gone.withColumnRenamed("row", "h"), id=key, h=F.xxhash64(key, F.col(text_col)))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)


OP10_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: md5(array_to_string(w[i:i + 2], ' ')))
                                      WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS t
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM (SELECT s.*, n.n FROM s JOIN n USING (doc_id)) x JOIN (SELECT s.*, n.n FROM s JOIN n USING (doc_id)) y
    ON x.t = y.t AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON d.doc_id = r.a
"""
