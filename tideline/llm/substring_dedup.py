"""Operator 8: substring dedup with Rabin-Karp hashes of every window of words.

Map: each task hashes the words of its texts and every window of them (vectorised), and settles
repeats among its own windows at once. So a window that occurs in a third of all documents leaves a
task once for each few MB of text, not once for each document. First occurrences travel in packed
blobs (two hashes, and id and start as compressed differences), dealt by hash.
Reduce: in each hash bucket every occurrence but the first (smallest id, then earliest start) is a
repeat. Repeats travel, packed likewise, to a bucket of their document, where they merge into
maximal intervals. A join brings the intervals to the texts that have any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import RK_OTHER, checkpoint, matched, mix, pack, shuffle_partitions, text_bytes, text_slices, tune, unpack, window_hashes, word_hashes

WINDOW = 20
#: Windows that a task holds at once, and bytes of text that it looks at together.
HOLD, SLICE = 1_500_000, 4 << 20
#: Bytes of text for a document bucket, about; a hash bucket, half of that, holds about 10 million windows.
BUCKET_BYTES = 96 << 20


def _packed(columns: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for rows that are sorted by document and start."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        yield int(bucket[rows[0]]), pack(*(c[rows] for c in columns))


def _settle(h: np.ndarray, check: np.ndarray, *at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by place (at): the indices of first occurrences, and of later ones."""
    order = np.argsort(h, kind="stable")
    alike = h[order][1:] == h[order][:-1]
    if (alike & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
        alike = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    new = np.append(np.ones(min(1, len(h)), bool), ~alike)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(h), bool)
    for c in at:
        later |= c[order] != c[head]
    return np.sort(order[new]), np.sort(order[later])


def _several(rows: DataFrame) -> bool:
    """Whether an id has more than one text; rows: id, h."""
    return not rows.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").isEmpty()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(id, h, spans): maximal intervals [begin, end) of words covered by windows that start earlier elsewhere.

    Words are runs of bytes other than ASCII white space, unchanged. Windows are equal when 96 bits
    of two independent hashes are: among the 10**13 windows of 100 TB, less than 10**-2 false pairs are
    expected. A document is an id and a text: h is the text's hash where an id of the table has several texts
    (they come in the order of their hashes), else 0; rows that repeat both are one document.
    Documents without such a window give no row, nor do texts that are null or shorter than a window,
    nor rows without an id. buckets: number of document buckets; by default one for each shuffle
    partition, or more where that makes them larger than BUCKET_BYTES, so that a task's memory
    doesn't grow with the input. There are twice as many hash buckets.
    """
    spark = docs.sparkSession
    tune(spark)
    cols = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text", f"xxhash64(`{text_col}`) h").where("id is not null and text is not null")
    if not _several(cols.select("id", "h")):
        cols = cols.withColumn("h", F.lit(0).cast("long"))
    n = buckets or max(shuffle_partitions(spark), -(-(cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))

    def home(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)

    def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["bucket", "blob"])

    def shipped(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort(cols[:1:-1])
        h, check, *at = (c[order] for c in cols)
        first, later = _settle(h, check, *at)
        rows = [*_packed([c[first] for c in (h, check, *at)], (h[first] % np.uint64(2 * n)).astype(np.int64))]
        return batch_of(rows + [(-1 - k, blob) for k, blob in _packed([c[later] for c in at], home(at[0][later]))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_slices(batches, SLICE):
            words, text = word_hashes(*text_bytes(batch.column("text")))
            h = window_hashes(words, window)
            if not len(h):
                continue
            inside = np.flatnonzero(text[: len(h)] == text[window - 1 :])
            check = (window_hashes(words, window, RK_OTHER) >> np.uint64(32)).astype(np.uint32)
            begin = np.searchsorted(text, np.arange(batch.num_rows))
            ids, kinds = (batch.column(c).to_numpy() for c in ("id", "h"))
            held.append((h[inside], check[inside], ids[text[inside]], kinds[text[inside]], inside - begin[text[inside]]))
            size += len(inside)
            if size >= HOLD:
                yield shipped(held)
                held, size = [], 0
        if size:
            yield shipped(held)

    def judged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if key[0].as_py() < 0:
            yield from (batch_of([(-1 - key[0].as_py(), x)]) for x in blobs)
            return
        h, check, *at = unpack(blobs, (np.uint64, np.uint32))
        order = np.lexsort(at[::-1])
        later = order[_settle(*(c[order] for c in (h, check, *at)))[1]]
        if len(later):
            yield batch_of([*_packed([c[later] for c in at], home(at[0][later]))])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, kind, start = unpack([x for batch in batches for x in batch.column("blob").to_pylist()])
        order = np.lexsort((start, kind, doc))
        doc, kind, start = doc[order], kind[order], start[order]
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])
        new = other.copy()
        new[1:] |= start[1:] > start[:-1] + window
        at = np.flatnonzero(new)
        end = start[np.append(at[1:], len(doc)) - 1] + window
        rows = np.flatnonzero(other[at])
        span = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(end)], ["begin", "end"])
        yield pa.RecordBatch.from_arrays([pa.array(doc[at][rows]), pa.array(kind[at][rows]), pa.ListArray.from_arrays(pa.array(np.append(rows, len(at)), pa.int32()), span)], ["id", "h", "spans"])

    firsts = cols.select("id", "h", "text").mapInArrow(mapped, "bucket int, blob binary")
    repeats = firsts.groupBy("bucket").applyInArrow(judged, "bucket int, blob binary")
    spans = repeats.groupBy("bucket").applyInArrow(merged, "id long, h long, spans array<struct<begin:long,end:long>>")
    return spans.withColumnRenamed("id", id_col)


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, n_removed): the words that no span covers, joined by one space.

    spans: as repeated_spans gives them, for the same table. Spans are clipped to the text. A null
    text counts as empty; a row without an id stays whole, and so does another text of a span's id.
    Texts without a span pass by without a shuffle.
    """
    tune(docs.sparkSession)
    spans = checkpoint(spans.selectExpr(f"`{id_col}` id", "h", "spans"))
    several = F.lit(0).cast("long") if spans.where("h <> 0").isEmpty() else F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), several.alias("h"))
    rest, hit = matched(rows, spans, ["id", "h"])
    both = rest.select("id", "text", F.lit(None).cast("array<struct<begin:long,end:long>>").alias("spans")).unionByName(hit.join(spans, ["id", "h"], "left").select("id", "text", "spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int]] = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                n, kept, at = len(words), [], 0
                for span in spans.as_py() or []:
                    kept += words[at : span["begin"]]
                    at = min(span["end"], n)
                kept += words[at:]
                rows.append((b" ".join(kept).decode(), n, n - len(kept)))
            text, n, gone = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["id", "text", "n_words", "n_removed"])

    return both.mapInArrow(cut, "id long, text string, n_words long, n_removed long").withColumnsRenamed({"id": id_col, "text": text_col})


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cut_spans(docs, repeated_spans(docs)).selectExpr("doc_id", "n_words", "n_removed", "sha2(text, 256) kept_sha256")


OP8_SQL = """
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)),
s AS (
  SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq FROM w),
r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(array_to_string(seq, ' ')) ORDER BY doc_id, pos) AS k
  FROM s WHERE len(seq) = 20),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM r, range(20) t(j) WHERE k > 1),
o AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
