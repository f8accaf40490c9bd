"""Operator 9: secret scans with multipart credential linking.

A scan of each whole text gives parts: base secrets, which always count, and weak candidates for an
access identifier, a secret or an endpoint. Weak ones are then interval-joined with the other parts
of their document: one is reported only if complementary parts lie within the same scope (SCOPE code
points around it): an identifier needs a secret, a secret needs an identifier, an endpoint needs
both. The join is a pair of running windows over the sorted parts (the furthest end before, the
nearest start after), so no pairs are made however many parts a document has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.llm.common import boxed, checkpoint, matched, same, tune

SCOPE = 300

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"""\b(?:ASIA[A-Z0-9]{12,}|(?:client|access_?key|account|app)[_-]?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{6,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
WEAK_END = re.compile(r"""\b(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""", re.I | re.A)
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
#: Which part of a credential a kind can be.
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}


def find_parts(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: base spans first by kind, then weak candidates that touch no base span."""
    low = text.lower()
    out = []
    if any(x in low for x in ("passw", "secret", "token", "key")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    weak = [("weak_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text)]
    if "asia" in low or "id" in low and ("=" in low or ":" in low):
        weak += [("weak_id", m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    if "://" in text:
        weak += [("weak_endpoint", m.start(), m.end()) for m in WEAK_END.finditer(text)]
    base = sorted(out, key=lambda x: x[1])
    at = 0
    for kind, start, end in sorted(weak, key=lambda x: x[1]):
        while at < len(base) and base[at][2] <= start:
            at += 1
        if at == len(base) or base[at][1] >= end:
            out.append((kind, start, end))
    return out


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row (id, h, kind, start, end) for each part, and one with a null kind for each input row."""
    tune(docs.sparkSession)
    kind_of = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                found = find_parts(text.as_py() or "")
                rows += [k] * (1 + len(found))
                kinds += [None, *(x[0] for x in found)]
                starts += [None, *(x[1] for x in found)]
                ends += [None, *(x[2] for x in found)]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("h").take(take), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "h", "kind", "start", "end"])

    rows = docs.selectExpr(f"`{id_col}` id", f"xxhash64(`{text_col}`) h", f"`{text_col}` text")
    return rows.mapInArrow(scan, f"id {kind_of}, h long, kind string, start long, end long")


def _is(part: str) -> Column:
    return F.col("kind").isin(*[k for k, v in PART.items() if v == part])


def credential_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, h, copies, spans): the reported spans of each document, sorted, as (start, rank, kind, end).

    Offsets are code points, ends exclusive; rank is the kind's place in KINDS; h is xxhash64 of the
    text. A null text counts as empty. Rows that repeat an id and text are one row, counted in
    copies. Documents without a span have an empty array, so none is lost.
    """
    parts = _parts(docs, id_col, text_col)
    before = Window.partitionBy("id", "h").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("id", "h").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(part: str) -> Column:
        back = F.max(F.when(_is(part), F.col("end"))).over(before) >= F.col("start") - scope
        ahead = F.min(F.when(_is(part), F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    linked = parts.withColumn("near_id", near("id")).withColumn("near_secret", near("secret"))
    weak = F.col("kind").startswith("weak")
    told = ~weak | F.when(_is("id"), F.col("near_secret")).when(_is("secret"), F.col("near_id")).otherwise(F.col("near_id") & F.col("near_secret"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.when(F.col("kind").isNotNull() & told, F.struct("start", rank.alias("rank"), "kind", "end"))
    out = linked.groupBy("id", "h").agg(F.count_if(F.col("kind").isNull()).alias("copies"), F.array_sort(F.collect_set(span)).alias("spans"))
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mask; all rows and columns stay, texts without one unchanged.

    Spans that overlap become one mask. Null and empty texts have no span; an empty table stays
    empty. Texts without a span pass by without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = checkpoint(credential_spans(rows, "id", "text").where("size(spans) > 0").select("id", "h", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")))
    rest, hit = matched(boxed(docs, id=F.col(id_col), h=F.xxhash64(text_col)), spans, ["id", "h"])
    hit = hit.join(spans, same(hit, spans, ["id", "h"]), "left").select("row", F.col("row")[text_col].alias("text"), "spans")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in found or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mask]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]) if found else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, batch.schema.field("text").type)], ["row", "text"])

    made = hit.mapInArrow(masked, StructType([hit.schema["row"], hit.schema["text"]]))
    both = rest.select("row", F.col("row")[text_col].alias("text")).unionAll(made)
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credential_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] <= 3)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = found.select("doc_id", "copies", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "_copy")
