"""Operator 1: exact deduplication by progressive refinement, with DataFrame functions only.

1. Rows are counted by byte length; a length with one row settles it.
2. Rows of the other lengths are counted by (length, hash of a short prefix); a pair with one row
   settles it, without a look at the rest of its text.
3. The whole content is hashed (SHA-256) for the rows of surviving groups alone, and rows are grouped
   by (length, prefix hash, full hash).

Surviving groups are marked in sieves, bit tables of bounded size (so their broadcast has a proven
bound). A marked slot that no surviving group owns only costs a needless hash; beyond some 10**8
surviving groups a sieve lets nearly all rows through, and the result is still the same. Only narrow
rows are shuffled, aggregates combine before the shuffle, and the join that hands each row its group
can be split where one text holds a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, sieve, sifted, skew_join, without

PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, carried columns.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the
    largest id stays (null ids sort below all others). Repeated rows (same id, same text) are all
    marked as kept when their id is the one that stays. An empty table gives an empty result; extra
    columns of docs are ignored unless carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.struct(*carry).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"),
        F.octet_length(text).cast("long").alias("_len"),
        text.alias("_text"),
    )
    lengths = checkpoint(rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"))
    rows = sifted(rows, F.xxhash64("_len"), sieve(lengths, F.xxhash64("_len")), "_long")
    rows = rows.withColumn("_ph", F.when(F.col("_long"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    prefixes = checkpoint(rows.where("_long").groupBy("_len", "_ph").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_ph"))
    pair = F.when(F.col("_ph").isNotNull(), F.col("_ph").bitwiseXOR(F.xxhash64("_len")))
    rows = sifted(rows, pair, sieve(prefixes, pair), "_same")
    marked = rows.select("_id", "_carry", "_len", "_ph", F.when(F.col("_same"), F.unhex(F.sha2("_text", 256))).alias("_fh"))
    keys = ["_len", "_ph", "_fh"]
    groups = marked.where("_fh is not null").groupBy(*keys).agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = skew_join(marked, groups, keys, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *([F.col("_carry")[c].alias(c) for c in carry]),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a row with a larger id has as well; all columns stay.

    A null text counts as empty, and of rows with a null id one text's all stay unless a row with an
    id has it. A row is told by its id and a hash of its text, so other texts with its id stay. An
    empty table stays empty.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h.alias("h"))
    gone = exact_groups(rows, "id", "text", carry=["h"]).where("not kept").select("id", "h")
    return without(docs, gone, id=F.col(id_col), h=h)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_groups(docs, carry=["text_sha256"])


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
