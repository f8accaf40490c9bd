"""Operator 4: language identification by Bayesian evidence fusion.

Evidence for each document: a naive Bayes likelihood of its byte trigrams (fitted on a bounded,
labelled sample), the language its markup declares, the language its address suffix suggests, and a
prior of its host. Host priors come from grouped aggregation over all documents and are smoothed
hierarchically: host towards its parent domain, that one towards its last label, and that one
towards the whole table. One more class,
"und" (undetermined), explains a text by single bytes alone; documents for which it wins, and those
without letters, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, skew_join, text_bytes, text_slices, tune, without
from tideline.llm.html_text import extract_text, host_of

#: Rows of the labelled sample at most (in expectation: rows are chosen by a hash of their id). All of its languages are told.
SAMPLE = 20_000
SLOTS = 1 << 16
#: Trigrams whose evidence counts in full; more ones are averaged down to that many.
EFFECTIVE = 60.0
#: How often a declaration, and an address suffix, tell the truth.
DECLARED, SUFFIX = 0.9, 0.75
#: Pseudo-counts that pull a host towards its domain, a domain towards its last label, and that one towards the whole table.
PULL = 20.0
#: Prior of "und", and by how much a trigram single bytes must explain a text better: a document with an
#: identifier or a number in it is still in its language.
UND, MARGIN = 1e-9, 1.5
SLICE = 2 << 20

#: Language by country-code suffix, for countries with one official language (or one that most pages are in).
SUFFIX_LANGUAGE = {
    "ad": "ca", "ae": "ar", "al": "sq", "ao": "pt", "ar": "es", "at": "de", "au": "en", "bd": "bn", "bg": "bg", "bo": "es",
    "br": "pt", "by": "ru", "cl": "es", "cn": "zh", "co": "es", "cr": "es", "cu": "es", "cz": "cs", "de": "de", "dk": "da",
    "do": "es", "dz": "ar", "ec": "es", "ee": "et", "eg": "ar", "es": "es", "fi": "fi", "fr": "fr", "ge": "ka", "gr": "el",
    "gt": "es", "hn": "es", "hr": "hr", "hu": "hu", "id": "id", "ie": "en", "il": "he", "iq": "ar", "ir": "fa", "is": "is",
    "it": "it", "jo": "ar", "jp": "ja", "kh": "km", "kr": "ko", "kw": "ar", "lt": "lt", "lv": "lv", "ly": "ar", "ma": "ar",
    "mk": "mk", "mn": "mn", "mx": "es", "my": "ms", "mz": "pt", "ni": "es", "nl": "nl", "no": "no", "nz": "en", "pa": "es",
    "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "rs": "sr", "ru": "ru", "sa": "ar", "se": "sv", "si": "sl",
    "sk": "sk", "sv": "es", "th": "th", "tr": "tr", "tw": "zh", "ua": "uk", "uk": "en", "us": "en", "uy": "es", "ve": "es",
    "vn": "vi",
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot) of every trigram of folded bytes with a letter in it; folded bytes and text bounds.

    ASCII letters are lower-cased, other ASCII becomes a space, bytes of other scripts stay.
    """
    data, at = text_bytes(column)
    data = _FOLD[data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), data, at
    d = data.astype(np.uint32)
    slot = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    use = (owner[:-2] == owner[2:]) & (data[1:-1] != 32)
    return owner[:-2][use], slot[use].astype(np.int64), data, at


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Trigram log-probabilities by language, and single-byte ones, from at most about `sample` labelled rows.

    Counts are summed by Spark for each label; the model has SLOTS numbers (0.25 MB) for each language
    of the sample. A table without labelled text gives a model without
    languages. Labels may be wrong at times: they are one kind of evidence when the model is applied.
    """
    tune(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{label_col}` as string) label", f"`{text_col}` text", f"xxhash64(`{id_col}`) h").where("label is not null and label <> '' and text is not null")
    n = rows.count()
    part = rows.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))).select("label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, SLICE):
            labels = np.array(batch.column("label").to_pylist())
            owner, slot, data, at = trigrams(batch.column("text"))
            byte_owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for x in set(labels.tolist()):
                own = tri.setdefault(x, np.zeros(SLOTS + 256, np.int64))
                own[:SLOTS] += np.bincount(slot[labels[owner] == x], minlength=SLOTS)
                own[SLOTS:] += np.bincount(data[labels[byte_owner] == x], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(list(tri), pa.string()), pa.array([x.tobytes() for x in tri.values()], pa.binary())], ["label", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        return pa.table({"label": table.column("label")[:1], "counts": pa.array([sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()).tobytes()], pa.binary())})

    found = {r.label: np.frombuffer(r.counts, np.int64) for r in part.mapInArrow(counted, "label string, counts binary").groupBy("label").applyInArrow(summed, "label string, counts binary").collect()}
    names = sorted(found)
    logs = [np.log((found[x][:SLOTS] + 0.2) / (found[x][:SLOTS].sum() + 0.2 * SLOTS)) for x in names]
    single = sum((found[x][SLOTS:] for x in names), np.zeros(256, np.int64)) + 1.0
    return {"languages": names, "tri": np.array(logs, np.float32).T.copy() if names else np.zeros((SLOTS, 0), np.float32), "byte": np.log(single / single.sum())}


def _scored(rows: DataFrame, model: dict) -> DataFrame:
    """(…, n_grams, ll): number of trigrams and the tempered log-likelihoods, "und" last, instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [f for f in rows.schema.fields if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_slices(batches, SLICE):
            owner, slot, data, at = trigrams(batch.column("text"))
            n = np.bincount(owner, minlength=batch.num_rows)
            ll = np.zeros((batch.num_rows, m["tri"].shape[1] + 1))
            for k in range(m["tri"].shape[1]):
                ll[:, k] = np.bincount(owner, weights=m["tri"][slot, k], minlength=batch.num_rows)
            if len(data) >= 3:
                b = m["byte"][data]
                whole = np.repeat(np.arange(len(at) - 1), np.diff(at))
                use = (whole[:-2] == whole[2:]) & (data[1:-1] != 32)
                ll[:, -1] = np.bincount(whole[:-2][use], weights=(b[:-2] + b[1:-1] + b[2:])[use], minlength=batch.num_rows)
            ll *= (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(n, pa.int64()), pa.array(list(ll), pa.list_(pa.float64()))], [*(f.name for f in others), "n_grams", "ll"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(score, f"{kinds}, n_grams long, ll array<double>")


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, url: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, host, language, confidence, kept): one row per input row.

    declared: what the markup says (null: no evidence; a language the model doesn't know: none).
    host: the key of the prior; its parent domain is what follows its first dot, and above that is its
    last label ("*" for hosts without a dot); null is a host of its own. url: its country suffix is evidence. A null or empty text, or one without letters, is
    "und" and rejected; so is one that single bytes explain better than any language with the other
    evidence. Ties go to the first language by name. A model without languages keeps all texts that
    have letters. Extra columns are ignored unless carried.
    """
    tune(docs.sparkSession)
    names = model["languages"]
    size = len(names)
    none = F.lit(None).cast("string")
    suffix = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://[^/?#:]*\.([a-z]{2})(?:[/?#:]|$)", 1)) if url is not None else none
    by_suffix = F.create_map(*[F.lit(x) for p in SUFFIX_LANGUAGE.items() for x in p])
    rows = docs.select(F.col(id_col).alias("id"), *carry, (declared if declared is not None else none).alias("declared"), F.element_at(by_suffix, suffix).alias("hint"), F.coalesce(host if host is not None else none, F.lit("")).alias("host"), F.col(text_col).alias("text"))
    scored = checkpoint(_scored(rows, model))
    if not names:
        return scored.select(F.col("id").alias(id_col), *carry, "host", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), (F.col("n_grams") > 0).alias("kept"))
    langs = F.array(*map(F.lit, names))

    def told(evidence: Column, truth: float) -> Column:
        miss = float(np.log((1 - truth) / max(size - 1, 1)))
        known = F.array_contains(langs, evidence)
        return F.when(known, F.transform(langs, lambda x: F.when(x == evidence, F.lit(float(np.log(truth)))).otherwise(F.lit(miss)))).otherwise(F.transform(langs, lambda x: F.lit(-float(np.log(size)))))

    own = F.slice("ll", 1, size)
    votes = scored.withColumn("e", F.zip_with(F.zip_with(own, told(F.col("declared"), DECLARED), lambda a, b: a + b), told(F.col("hint"), SUFFIX), lambda a, b: a + b))
    votes = votes.withColumn("vote", F.when(F.col("n_grams") > 0, F.array_position("e", F.array_max("e"))))
    dotted = F.instr("host", ".") > 0
    domain = F.when(dotted, F.expr("substring(host, instr(host, '.') + 1)")).otherwise("*").alias("domain")
    label = F.when(F.instr("domain", ".") > 0, F.substring_index("domain", ".", -1)).otherwise(F.col("domain")).alias("label")
    ks = range(size)
    sums = lambda x, y: [F.sum(f"{x}{k}").alias(f"{y}{k}") for k in ks]
    hosts = checkpoint(votes.groupBy("host").agg(*[F.count_if(F.col("vote") == k + 1).cast("double").alias(f"c{k}") for k in ks]).select("*", domain))
    domains = hosts.groupBy("domain").agg(*sums("c", "d")).select("*", label)
    labels = domains.groupBy("label").agg(*sums("d", "t"))
    whole = labels.agg(*sums("t", "w")).first()
    total = float(sum(x or 0 for x in whole))
    base = [((x or 0) + 1) / (total + size) for x in whole]

    def pulled(x: str, up: list) -> list[Column]:
        n = sum((F.col(f"{x}{k}") for k in ks), F.lit(0.0))
        return [(F.col(f"{x}{k}") + PULL * up[k]) / (n + PULL) for k in ks]

    top = labels.select("label", *[c.alias(f"q{k}") for k, c in enumerate(pulled("t", [F.lit(x) for x in base]))])
    middle = skew_join(domains, top, ["label"])
    middle = middle.select("domain", *[c.alias(f"p{k}") for k, c in enumerate(pulled("d", [F.col(f"q{k}") for k in ks]))])
    priors = skew_join(hosts, middle, ["domain"]).select("host", F.array(*map(F.ln, pulled("c", [F.col(f"p{k}") for k in ks]))).alias("prior"))
    fused = skew_join(votes, priors, ["host"], "left").withColumn("p", F.zip_with("e", "prior", lambda a, b: a + b))
    lost = F.element_at("ll", -1) + F.lit(float(np.log(UND)) - 2 * float(np.log(size))) - MARGIN * F.least(F.col("n_grams").cast("double"), F.lit(EFFECTIVE))
    best = F.array_max("p")
    found = (F.col("n_grams") > 0) & (best >= lost)
    mass = F.aggregate("p", F.exp(lost - best), lambda a, x: a + F.exp(x - best))
    language = F.when(found, F.element_at(langs, F.array_position("p", best).cast("int"))).otherwise(F.lit("und"))
    return fused.select(F.col("id").alias(id_col), *carry, "host", language.alias("language"), F.when(found, 1 / mass).otherwise(F.lit(0.0)).alias("confidence"), F.coalesce(found, F.lit(False)).alias("kept"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """documents without the rows that are rejected; all columns stay. lang is the declared language, source the host.

    Null and empty texts, and those without letters, are rejected. A row is told by its id and a hash
    of all that its verdict depends on, so other rows with its id stay. An empty table stays empty.
    """
    given = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("")) for c in ("text", "lang", "source")]
    rows = docs.select("doc_id", "text", "lang", "source", F.xxhash64(*given).alias("h"))
    out = identify(rows, fit(rows), declared=F.col("lang"), host=F.col("source"), carry=["h"])
    return without(docs, out.where("not kept").select(F.col("doc_id").alias("id"), "h"), id=F.col("doc_id"), h=F.xxhash64(*given))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page's article, from its text, the language its markup declares, its address and its host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1))
    texts = extract_text(pages.select(F.struct("page_id", declared.alias("declared")).alias("page"), "url", "html"), "page")
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = identify(texts, model, "page", declared=F.col("page.declared"), host=host_of("url"), url=F.col("url"))
    return out.select("page.page_id", "host", "page.declared", "language", F.round("confidence", 6).alias("confidence"), "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs), declared=F.col("lang"), host=F.col("source")).withColumn("confidence", F.round("confidence", 6))
