"""Operator 3: line dedup by overlapping three-line windows, with DataFrame functions only.

Each run of three consecutive lines is hashed (two 64-bit hashes). Windows found more than once are
joined with their first occurrence (smallest id, then earliest line); every later occurrence covers
its three lines, the covered positions of a document are merged, and those lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import boxed, checkpoint, matched, same, skew_join

WINDOW = 3


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, h, covered): for each document with a later copy of a window, the sorted 0-based lines it covers.

    Lines are split at \\n and compared as they are. A text with fewer lines than a window has none.
    Rows without an id take no part. A document is an id and a text (h is the text's hash): other
    texts of its id are other documents, and rows that repeat both are one.
    """
    h = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), _lines(text_col).alias("_l")).where(F.size("_l") >= window)
    h = h.select("_id", "_h", F.transform("_l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("_l"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("_l") - window),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get("_l", i + k)["a"] for k in range(window)]).alias("a"),
            F.xxhash64(*[F.get("_l", i + k)["b"] for k in range(window)]).alias("b"),
        ),
    )
    wins = h.select("_id", "_h", F.explode(spans).alias("w")).select("_id", "_h", "w.pos", "w.a", "w.b")
    firsts = wins.groupBy("a", "b").agg(F.min(F.struct("_id", "_h", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = skew_join(wins, firsts, ["a", "b"]).where(F.struct("_id", "_h", "pos") != F.col("first"))
    cover = later.groupBy("_id", "_h").agg(F.collect_set("pos").alias("p"))
    every = F.flatten(F.transform("p", lambda x: F.sequence(x, x + window - 1)))
    return cover.select(F.col("_id").alias(id_col), F.col("_h").alias("h"), F.array_sort(F.array_distinct(every)).alias("covered"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the covered lines removed from the text, and the columns n_lines and n_removed (in place of ones of that name).

    A null text stays null and counts as one empty line. Other columns stay as they are. Texts
    without a covered line pass by without a shuffle.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    covered = checkpoint(covered_lines(narrow, "id", "text", window))
    rest, hit = matched(boxed(docs, id=F.col(id_col), h=F.xxhash64(text_col)), covered, ["id", "h"])
    hit = hit.join(covered, same(hit, covered, ["id", "h"]), "left").select("row", "covered")
    both = rest.select("row", F.lit(None).cast("array<int>").alias("covered")).unionAll(hit)
    text = F.col("row")[text_col]
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # The positions left come from one hashed difference, and each is one look into an array that is split once.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "covered")
    split = F.array(F.struct(lines.alias("lines"), left.alias("left")))
    kept = F.get(F.transform(split, lambda s: F.array_join(F.transform(s["left"], lambda i: F.get(s["lines"], i)), "\n")), 0)
    made = F.when(F.col("covered").isNull(), text).otherwise(kept).alias(text_col)
    return both.select(
        *[made if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.array_size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents),
w AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k
  FROM w WHERE l3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later, (VALUES (0), (1), (2)) t(j) WHERE k > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
"""
