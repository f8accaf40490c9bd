"""Operator 12: phrase collocations by multikey three-way quicksort of suffix pointers.

Phrases are counted one depth after the other. A task sorts the suffix pointers of some MB of text by their
first words, up to that depth: the sizes of the equal partitions are its counts. Those are routed by the
leading words, as many as are counted, so that a hot word is dealt over all buckets; a bucket
sorts the pointers of all tasks likewise, adds up, and abandons partitions that stay infrequent. A deeper suffix
is followed only where its leading and its trailing words are a frequent phrase of the depth before (looked up in a
bit table of bounded size, which may let some others through: they are abandoned in their bucket).
What is frequent then meets in joins: cuts, scores, longer phrases, ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import _RK, bit_table, checkpoint, gathered, looked_up, mix, pack, shuffle_partitions, skew_join, text_bytes, tune, unpack, word_spans

#: Occurrences that make a phrase a candidate, and the share (percent) of them inside a longer one that drops it.
LEAST, INSIDE = 10, 50
#: Bytes of text whose suffix pointers a task sorts together, pointers in a bucket (before equal ones are added up).
HOLD, BUCKET = 8 << 20, 4_000_000
#: Parts of a language that are ranked apart before its candidates meet.
PARTS = 64
#: Partitions of fewer pointers are sorted at once.
SMALL = 1 << 15

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in " \t.,;:!?\n\v\f\r"]] = True
_BREAK = _BETWEEN.copy()
_BREAK[[0x20, 0x09]] = False


def equal_partitions(keys: list[np.ndarray], weights: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(pointer, count) of each group of rows with equal keys whose weights sum to least or more.

    Multikey three-way quicksort: rows less than, equal to and greater than a pivot in the key of the
    present depth; the equal ones go on with the next key. A partition whose weights sum to
    less than least is abandoned, unsorted.
    """
    heads, counts = [], []
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        at, depth = stack.pop()
        if not len(at) or int(weights[at].sum()) < least:
            continue
        if depth == len(keys):
            heads.append(at[:1])
            counts.append(np.array([weights[at].sum()]))
        elif len(at) <= SMALL:
            order = at[np.lexsort([k[at] for k in reversed(keys[depth:])])]
            new = np.append(True, np.zeros(len(at) - 1, bool))
            for k in keys[depth:]:
                new[1:] |= k[order[1:]] != k[order[:-1]]
            first = np.flatnonzero(new)
            count = np.add.reduceat(weights[order], first)
            heads.append(order[first[count >= least]])
            counts.append(count[count >= least])
        else:
            key = keys[depth][at]
            pivot = np.sort(key[:: len(key) // 99])[49]
            less, equal = key < pivot, key == pivot
            stack += [(at[less], depth), (at[~(less | equal)], depth), (at[equal], depth + 1)]
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (heads, counts))


def joined(keys: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of a phrase."""
    h = keys[0]
    for k in keys[1:]:
        h = mix(h * _RK + k)
    return h


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(hash of language and word, piece, text, first byte, bytes, all bytes) of the words of a batch (lang, text)."""
    data, at = text_bytes(batch.column("text"))
    words, text, start, size = word_spans(data, at, lower=True, between=_BETWEEN)
    langs = batch.column("lang").dictionary_encode()
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], np.uint64)
    piece = np.append(0, np.cumsum(_BREAK[data]))[start] + text
    return mix(words ^ salt[langs.indices.to_numpy()][text]) if len(words) else words, piece, text, start, size, data


def _strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The lower-cased words that lie at start in data."""
    ends = np.cumsum(size)
    place = np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
    raw = data[place]
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def frequent_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, h, f) of words that occur least times in a language, and (lang, null, null, n): all its words. docs: lang, text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, HOLD):
            h, _, text, start, size, data = _words(batch)
            head, count = equal_partitions([h], np.ones(len(h), np.int64))
            langs = batch.column("lang").dictionary_encode()
            total = np.bincount(langs.indices.to_numpy()[text], minlength=len(langs.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("lang").take(pa.array(text[head])), langs.dictionary]),
                    pa.concat_arrays([_strings(data, start[head], size[head]), pa.nulls(len(total), pa.string())]),
                    pa.concat_arrays([pa.array(h[head].view(np.int64)), pa.nulls(len(total), pa.int64())]),
                    pa.array(np.append(count, total)),
                ],
                ["lang", "word", "h", "f"],
            )

    found = docs.mapInArrow(counted, "lang string, word string, h long, f long").groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("f").alias("f"))
    return found.where(f"f >= {least} or word is null and f > 0")


def frequent_phrases(docs: DataFrame, depth: int, before: np.ndarray, total: int, least: int = LEAST) -> DataFrame:
    """(h1, ..., f): the word hashes and count of every phrase of depth words that occurs least times.

    before: the bit table of frequent phrases of one word less; total: the number of words in docs (lang, text).
    """
    spark = docs.sparkSession
    names = [f"h{k + 1}" for k in range(depth)]
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET))
    table = spark.sparkContext.broadcast(before)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, HOLD):
            h, piece, *_ = _words(batch)
            n = len(h) - depth + 1
            if n <= 0:
                continue
            known = looked_up(table.value, joined([h[k : len(h) - depth + 2 + k] for k in range(depth - 1)]))
            at = np.flatnonzero((piece[:n] == piece[depth - 1 :]) & known[:-1] & known[1:])
            keys = [h[at + k] for k in range(depth)]
            head, count = equal_partitions(keys, np.ones(len(at), np.int64))
            keys = [k[head] for k in keys]
            bucket = (joined(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            rows = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            blobs = [pack(*(k[r] for k in keys), count[r]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([bucket[r[0]] for r in rows], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *keys, count = unpack([x for batch in batches for x in batch.column("blob").to_pylist()], (np.uint64,) * depth)
        head, total = equal_partitions(keys, count, least)
        yield pa.RecordBatch.from_arrays([*(pa.array(k[head].view(np.int64)) for k in keys), pa.array(total)], [*names, "f"])

    def reduced(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(batches)

    return docs.mapInArrow(counted, "bucket long, blob binary").groupBy("bucket").applyInArrow(reduced, ", ".join(f"{c} long" for c in [*names, "f"]))


def _table(phrases: DataFrame, names: list[str]) -> np.ndarray:
    """The bit table of the phrases' joined keys."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b.column(c).to_numpy().view(np.uint64) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(joined(keys).view(np.int64))], ["key"])

    return bit_table(phrases.select(*names).mapInArrow(keyed, "key long"), F.col("key"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to 38 digits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    square = (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def candidates(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, phrase, a, l, r, score, longer), and (lang, n): all words of each language.

    A-Z are lower-cased; texts are split at . , ; : ! ? and line ends into pieces, these at spaces and tabs into words. Null texts
    are empty, a null language is `und`. A candidate is a phrase of two or three words that occurs least
    times; l and r are the counts of the parts of its lowest-scoring cut (the first of equal ones), longer
    is the count of the most frequent candidate of three words that one of two lies in (else null).
    Words are equal when 64 bits of their hashes are. Rows that repeat count as often as they stand there.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    words = checkpoint(frequent_words(rows, least))
    totals = words.where("word is null").selectExpr("lang", "f n")
    words = words.where("word is not null")
    total = totals.agg(F.sum("n")).first()[0] or 0
    pairs = checkpoint(frequent_phrases(rows, 2, _table(words.withColumnRenamed("h", "h1"), ["h1"]), total, least))
    triples = checkpoint(frequent_phrases(rows, 3, _table(pairs, ["h1", "h2"]), total, least))
    one = words.selectExpr("h h1", "lang", "word w1", "f f1")
    two = words.selectExpr("h h2", "word w2", "f f2")
    pairs = checkpoint(skew_join(skew_join(pairs, one, ["h1"]), two, ["h2"]))
    front = pairs.selectExpr("h1", "h2", "f f12", "lang", "w1", "w2", "f1")
    back = pairs.selectExpr("h1 h2", "h2 h3", "f f23", "w2 w3", "f2 f3")
    triples = checkpoint(skew_join(skew_join(triples, front, ["h1", "h2"]), back, ["h2", "h3"]))
    inside = triples.select("f", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"))
    longer = inside.groupBy("p.h1", "p.h2").agg(F.max("f").alias("longer"))
    short = skew_join(pairs, longer, ["h1", "h2"], "left").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "longer"
    ).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    cut1, cut2 = score(F.col("f"), F.col("f1"), F.col("f23")), score(F.col("f"), F.col("f12"), F.col("f3"))
    cut = F.when(cut1 <= cut2, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), cut1.alias("score"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), cut2.alias("score")))
    long = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), cut.alias("cut")).selectExpr("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cast(null as long) longer")
    return short.unionByName(long), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = 2000, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first candidates by score, then count, then phrase.

    Those go that lie in a longer candidate with inside percent of their occurrences or more. See candidates.
    """
    found, totals = candidates(docs, lang_col, text_col, least)
    left = found.where(f"longer is null or 100 * longer < {int(inside)} * a")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # First the best of each part of a language: a language's last task then reads PARTS * top rows at most.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    left = left.withColumn("_k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_k") <= top).drop("_k")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM p) GROUP BY lang, w1),
s AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p),
two AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM s WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
c2 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM two t JOIN one x ON t.lang = x.lang AND t.w1 = x.w1 JOIN one y ON t.lang = y.lang AND t.w2 = y.w1
  LEFT JOIN longer g ON t.lang = g.lang AND t.w1 = g.w1 AND t.w2 = g.w2
  WHERE g.m IS NULL OR 100 * g.m < 50 * t.f),
c3 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, o1.f AS l1, t23.f AS r1, t12.f AS l2, o3.f AS r2,
         CAST(CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(o1.f AS HUGEINT) * t23.f) AS BIGINT) AS s1,
         CAST(CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(t12.f AS HUGEINT) * o3.f) AS BIGINT) AS s2
  FROM three t JOIN one o1 ON t.lang = o1.lang AND t.w1 = o1.w1 JOIN one o3 ON t.lang = o3.lang AND t.w3 = o3.w1
  JOIN two t12 ON t.lang = t12.lang AND t.w1 = t12.w1 AND t.w2 = t12.w2
  JOIN two t23 ON t.lang = t23.lang AND t.w2 = t23.w1 AND t.w3 = t23.w2),
c AS (
  SELECT lang, phrase, a, l, r, score FROM c2
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked k JOIN totals t ON k.lang = t.lang WHERE rank <= 2000
"""
