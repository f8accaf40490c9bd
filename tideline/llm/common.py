"""Shared helpers: checkpoints, sieves, vectorised words, window hashes, packed columns and components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: long documents then cost a worker tens of MB, not gigabytes.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. A smaller value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder named in spark.checkpoint.dir and go on from there.

    Only a session on one machine (local master) that names no folder gets a temporary one: on a
    cluster, executors could not read it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys adaptive execution can split, even if right is an aggregate.

    A join that reuses an aggregate's own partitioning can't be split; the key that is made of the
    others has Spark shuffle both sides for the join.
    """
    more = F.hash(*keys)
    return left.withColumn("_even", more).join(right.withColumn("_even", more), [*keys, "_even"], how).drop("_even")


# ---------------------------------------------------------------- sieves

#: A bucket of a sieve has 32,768 bits (4 KB); a sieve has SPARSE bits a key, and MOST_BUCKETS (16 MB) at most.
SPARSE, MOST_BUCKETS = 16, 4096


def _slot(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets * 32768)).cast("long") + 1


def sieve(keys: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """Bit table of 64-bit keys with its number of buckets, of bounded size and so fit for a broadcast.

    keys are read twice, so they had better be written. A full sieve lets everything through.
    """
    buckets = min(MOST_BUCKETS, 1 << (keys.count() * SPARSE // 32768).bit_length())
    slots = keys.select(_slot(key, buckets).alias("_slot")).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    # Dealt before they are summed: a slot takes less space than a task's 4 KB for its bucket.
    return F.broadcast(slots.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))), buckets


def sifted(df: DataFrame, key: Column, sieve: tuple[DataFrame, int], name: str) -> DataFrame:
    """df with a boolean column: whether the key's bit is set (false for a null key). df has no column named _slot, _bucket or _bits."""
    bits, buckets = sieve
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (at % 8).cast("int")) == 1
    rows = df.withColumn("_slot", _slot(key, buckets)).withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(bits, "_bucket", "left")
    return rows.withColumn(name, F.coalesce(set_, F.lit(False))).drop("_slot", "_bucket", "_bits")


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row of docs as one struct `row`, and keys beside it: no name of docs can clash with a helper's."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def matched(rows: DataFrame, marks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can't have a mark, and those that may: only the latter need a shuffle to meet the marks."""
    open_ = sifted(rows, F.xxhash64(*keys), sieve(marks, F.xxhash64(*keys)), "_open")
    return open_.where("not _open").drop("_open"), open_.where("_open").drop("_open")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys of two DataFrames; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """docs without the rows whose keys are in gone (columns of the keys' names); all columns stay."""
    gone = checkpoint(gone.distinct())
    rest, hit = matched(boxed(docs, **keys), gone, list(keys))
    left = hit.join(gone, same(hit, gone, list(keys)), "left_anti")
    return rest.select("row").unionAll(left.select("row")).select("row.*")


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FNV, _FNV_START = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)
_RK, RK_OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins and ends in them; null is empty."""
    column = pa.array([], pa.large_string()) if not len(column) else column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (a run of bytes other than ASCII white space) and the text it is in."""
    return word_spans(data, at, lower)[:2]


def word_spans(data: np.ndarray, at: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first byte, bytes) of each word: a run of bytes that are not marked in between. lower: A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    data = _LOWER[data] if lower else data
    out = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, ends = out.copy(), out.copy()
    begins[1:] &= ~out[:-1] | edge[1:-1]
    ends[:-1] &= ~out[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    text = np.searchsorted(at, start, "right") - 1
    h = np.full(len(start), _FNV_START)
    live, where, left = np.arange(len(start)), start.copy(), size.copy()
    while len(live):
        h[live] = (h[live] ^ data[where]) * _FNV
        where, left = where + 1, left - 1
        if not left.all():
            more = left > 0
            live, where, left = live[more], where[more], left[more]
    return mix(h ^ size.astype(np.uint64)), text, start, size


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = _RK) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64, then mixed) of every run of width words, by doubling."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, have, part, size, power = np.zeros(len(words), np.uint64), 0, words, 1, base
    while True:
        if width & size:
            # done covers the first `have` words of each window; part covers the next `size`.
            done = done[: len(part) - have] * power + part[have:] if have else part
            have += size
        if size * 2 > width:
            return mix(done[:n])
        part = part[: len(part) - size] * power + part[size:]
        size, power = size * 2, np.uint64(int(power) ** 2 % 2**64)


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice has about most_bytes of text at most, or one row."""
    for batch in batches:
        at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, (at[begin - 1] if begin else 0) + most_bytes, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about most_bytes of text, whatever the sizes they come in; a longer text is alone."""
    held, size = [], 0
    for batch in text_slices(batches, most_bytes):
        more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + more > most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held, size = [*held, batch], size + more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bit_table(keys: DataFrame, key: Column) -> np.ndarray:
    """The sieve of the keys as one array of bytes (16 MB at most), for tasks that look keys up themselves."""
    rows, buckets = sieve(keys, key)
    out = np.zeros(buckets * 4096, np.uint8)
    for r in rows.collect():
        out[(r["_bucket"] - 1) * 4096 : r["_bucket"] * 4096] = np.frombuffer(bytes(r["_bits"]), np.uint8)
    return out


def looked_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit key is set in a bit_table."""
    slot = np.mod(keys.view(np.int64), np.int64(len(table) * 8))
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- packed columns


def pack(*columns: np.ndarray) -> bytes:
    """Columns as bytes; each but hashes (unsigned) is stored as 64-bit differences, compressed where that is shorter."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        hashed = c.dtype.kind == "u"
        raw = c.tobytes() if hashed else np.diff(c.astype(np.int64), prepend=0).tobytes()
        if not hashed:
            raw = min(raw, pa.compress(raw, "zstd", asbytes=True), key=len)
        out += [len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unpack(blobs: list[bytes], hashed: tuple[type, ...] = ()) -> list[np.ndarray]:
    """The columns of packed bytes, one after the other; the first ones are hashes of the given types."""
    parts: list[list[np.ndarray]] = []
    for blob in blobs:
        n, at, row = int.from_bytes(blob[:8], "little"), 8, []
        while at < len(blob):
            size = int.from_bytes(blob[at : at + 8], "little")
            raw = blob[at + 8 : at + 8 + size]
            at += 8 + size
            if len(row) < len(hashed):
                row.append(np.frombuffer(raw, hashed[len(row)]))
            else:
                row.append(np.cumsum(np.frombuffer(raw if size == 8 * n else pa.decompress(raw, 8 * n, "zstd"), np.int64)))
        parts.append(row)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) for each id that has an edge.

    component is the smallest id reachable. Alternates the large-star and small-star steps, each a
    map-side combined minimum and a join that can be split, so that a hot id costs no single task;
    ends when a round changes nothing. Every round is checkpointed.
    """
    def signature(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while before != (now := signature(e)):
        before = now
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = skew_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, least, ["a"])
        e = checkpoint(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
