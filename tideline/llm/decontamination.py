"""Operator 13: benchmark decontamination with an FM-index for each shard of the training texts.

A task cuts its texts into shards of a few MB. Words that no test phrase has can't lie in an occurrence;
they separate stretches of the others, whose symbols form the shard's index: a suffix array, the
Burrows-Wheeler transform as a wavelet matrix (a bit vector with counts for each bit of a symbol), and
the positions of every SAMPLE-th suffix. All phrases are searched backward at once, two ranks a word;
rows of the intervals found walk back to a sampled position. Covered words merge into spans.

Test phrases reach the tasks in blocks of BLOCK (phrase, item) pairs: one block passes through the driver at a
time, and every block is searched in all shards within one stage, without a shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, gathered, text_bytes, tune, word_spans

#: Words of a test phrase; an item of fewer words is one phrase.
WIDTH = 10
#: Bytes of text in a shard, symbols in an index, (phrase, item) pairs in a block, distance of sampled positions.
SHARD, SYMBOLS, BLOCK, SAMPLE = 4 << 20, 1 << 20, 100_000, 8

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class FMIndex:
    """Search in one sequence of symbols from 1 on; symbol 0 separates stretches and is in no phrase."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        n = len(text)
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 0)
        # No walk goes on past the start of a stretch: it is always sampled.
        sampled = (before == 0) | (order % SAMPLE == 0)
        self.position = np.where(sampled, order, -1)
        self.first = np.searchsorted(text[order], np.arange(symbols + 2))
        self.ones: list[np.ndarray] = []
        for bit in reversed(range(int(symbols).bit_length())):
            one = (before >> bit & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(one, dtype=np.int32)))
            before = np.concatenate([before[~one], before[one]])
        self.n = n
        every = np.arange(symbols + 1)
        self.base = self._down(every, np.zeros(symbols + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place of each (symbol, i) below the last level of the wavelet matrix."""
        for level, ones in enumerate(self.ones):
            up = ones[i].astype(np.int64)
            i = np.where(symbol >> (len(self.ones) - 1 - level) & 1 == 1, self.n - int(ones[-1]) + up, i - up)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row i."""
        return self._down(symbol, i) - self.base[symbol]

    def step(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer, for rows whose symbol isn't 0."""
        symbol = np.zeros(len(i), np.int64)
        at = i
        for ones in self.ones:
            up = ones[at].astype(np.int64)
            bit = ones[at + 1] > up
            symbol = symbol * 2 + bit
            at = np.where(bit, self.n - int(ones[-1]) + up, at - up)
        return self.first[symbol] + at - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) for each row of phrases (all of one length) that occurs."""
        which, last = np.arange(len(phrases)), phrases[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in reversed(range(phrases.shape[1])):
            if k < phrases.shape[1] - 1:
                symbol = phrases[which, k]
                low, high = (self.first[symbol] + self.rank(symbol, x) for x in (low, high))
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of the rows begin."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            found = self.position[at] >= 0
            out[left[found]] = self.position[at[found]] + steps
            left, at, steps = left[~found], self.step(at[~found]) if not found.all() else at[:0], steps + 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each of which ends at its first 0 (zeros: in order of position).

    Ranks of prefixes of twice the length a round; only suffixes that still share a rank are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.append(True, np.diff(text[order]) != 0)
    new[: int((text == 0).sum())] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while True:
        shared = ~(new & np.append(new[1:], True))
        at = np.flatnonzero(shared)
        if not len(at):
            return order
        some = order[at]
        key = rank[some] * n + rank[some + width]
        by = np.argsort(key)
        order[at], key = some[by], key[by]
        new[at] = np.append(True, key[1:] != key[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        width *= 2


def test_phrases(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (phrase, item): the hashes of each width consecutive words of an item, or of all where it has fewer.

    Null texts, and texts and items without a word or an id, have none.
    """
    tune(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SHARD):
            words, text, *_ = word_spans(*text_bytes(batch.column("text")), lower=True, between=_BETWEEN)
            at = np.searchsorted(text, np.arange(batch.num_rows + 1))
            items, rows, phrases = batch.column("item").to_pylist(), [], []
            for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                for i in range(a, max(a + (b > a), b - width + 1)):
                    rows.append(items[r])
                    phrases.append(words[i : min(i + width, b)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(rows, pa.string())], ["phrase", "item"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(cut, "phrase binary, item string").distinct()


class _Block:
    """Phrases of one block by length, over the symbols of their own words."""

    def __init__(self, phrases: list[bytes], items: list[str]):
        kinds = sorted({*phrases}, key=lambda p: (len(p), p))
        number = {p: k for k, p in enumerate(kinds)}
        order = np.argsort([number[p] for p in phrases], kind="stable")
        self.items = [items[k] for k in order]
        self.bounds = np.searchsorted([number[phrases[k]] for k in order], np.arange(len(kinds) + 1))
        self.words = np.unique(np.frombuffer(b"".join(kinds), np.uint64))
        self.groups, at = [], 0
        for size in sorted({len(p) for p in kinds}):
            group = [p for p in kinds if len(p) == size]
            symbols = np.searchsorted(self.words, np.frombuffer(b"".join(group), np.uint64)).reshape(len(group), -1) + 1
            self.groups.append((at, symbols))
            at += len(group)
        self.least = self.groups[0][1].shape[1]

    def occurrences(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, phrase) of every occurrence within a text."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        kept = np.flatnonzero(self.words[at] == words)
        # A separator after each stretch of words that follow each other in one text.
        cut = np.append((np.diff(kept) > 1) | (np.diff(text[kept]) != 0), True)[: len(kept)]
        ends = np.flatnonzero(cut)
        size = np.diff(ends, prepend=-1)
        long = np.repeat(size >= self.least, size)
        kept, cut = kept[long], cut[long]
        place = np.arange(len(kept)) + np.cumsum(cut) - cut
        symbols = np.zeros(len(kept) + int(cut.sum()), np.int64)
        source = np.zeros(len(symbols), np.int64)
        symbols[place], source[place] = at[kept] + 1, kept
        most, found = self.groups[-1][1].shape[1], []
        for begin in range(0, len(symbols), SYMBOLS):
            index = FMIndex(symbols[begin : begin + SYMBOLS + most - 1], len(self.words))
            for base, phrases in self.groups:
                which, low, high = index.search(phrases)
                count = high - low
                rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                where = index.locate(rows)
                inside = where < SYMBOLS
                found.append((source[begin + where[inside]], np.full(int(inside.sum()), phrases.shape[1]), np.repeat(which, count)[inside] + base))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def items_of(self, row: np.ndarray, phrase: np.ndarray, rows: int) -> list[set[str]]:
        out: list[set[str]] = [set() for _ in range(rows)]
        for key in np.unique(row * (len(self.bounds) + 1) + phrase):
            r, p = divmod(int(key), len(self.bounds) + 1)
            out[r].update(self.items[self.bounds[p] : self.bounds[p + 1]])
        return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block: int = BLOCK
) -> DataFrame:
    """One row a document: (id, text, n_words, hits, items).

    Words are runs of ASCII letters (A-Z lower-cased), digits and bytes beyond ASCII; words are equal
    when 64 bits of their hashes are. hits are the maximal stretches [begin, end) of words that
    occurrences of phrases cover, with their place in the text (low, high: code points); items the
    ids of the items with an occurring phrase, as sorted strings. Null texts have no words; repeated
    rows and null ids give a row each. Without a phrase no document has a hit. block: pairs that pass
    through the driver, and are searched, at a time.
    """
    spark = docs.sparkSession
    tune(spark)
    pairs = checkpoint(test_phrases(benchmark, item_col, item_text_col, width))
    blocks = max(1, -(-pairs.count() // block))
    span = pa.struct([(k, pa.int64()) for k in ("begin", "end", "low", "high")])
    schema = "id long, text string, n_words long, hits array<struct<begin:long,end:long,low:long,high:long>>, items array<string>"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for k in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == k).toArrow()
        phrases, items = (rows.column(c).to_pylist() for c in ("phrase", "item"))
        shared = spark.sparkContext.broadcast(_Block(phrases, items) if phrases else None)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, SHARD):
                data, at = text_bytes(batch.column("text"))
                words, text, start, size = word_spans(data, at, lower=True, between=_BETWEEN)
                n, earlier = batch.num_rows, "hits" in batch.schema.names
                change = np.zeros(len(words) + 1, np.int64)
                found: list[set[str]] = [set() for _ in range(n)]
                if shared.value is not None and len(words):
                    first, length, phrase = shared.value.occurrences(words, text)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + length, -1)
                    found = shared.value.items_of(text[first], phrase, n)
                begin = np.searchsorted(text, np.arange(n))
                if earlier:
                    hits = batch.column("hits")
                    flat, row = hits.flatten(), np.repeat(np.arange(n), hits.value_lengths().to_numpy())
                    for name, sign in (("begin", 1), ("end", -1)):
                        np.add.at(change, begin[row] + flat.field(name).to_numpy(), sign)
                    found = [a.union(b) for a, b in zip(found, batch.column("items").to_pylist(), strict=True)]
                hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                new = np.append(True, (np.diff(hit) > 1) | (np.diff(text[hit]) != 0))[: len(hit)]
                heads, tails = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
                rows = text[heads]
                # Code points before each byte of the texts that are hit.
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if len(hit) else np.zeros(1, np.int64)
                origin = points[at[rows]]
                columns = (heads - begin[rows], tails + 1 - begin[rows], points[start[heads]] - origin, points[start[tails] + size[tails]] - origin)
                spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), spans)
                items = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(np.bincount(text, minlength=n), pa.int64()), lists, items], ["id", "text", "n_words", "hits", "items"])

        out = out.mapInArrow(searched, schema)
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def cut_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text, n_words, hits, items) with the hit spans cut out of the text, all else in it as it was; null texts stay null."""
    out = leaks(docs, benchmark, id_col, text_col, **options)
    tail = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def cut(state, span):
        kept = F.substring(F.col(text_col), (state["at"] + 1).cast("int"), (span["low"] - state["at"]).cast("int"))
        return F.struct(span["high"].alias("at"), F.concat(state["done"], kept).alias("done"))

    rest = F.aggregate("hits", tail, cut, lambda s: F.concat(s["done"], F.substring(F.col(text_col), (s["at"] + 1).cast("int"), F.length(text_col))))
    return out.withColumn(text_col, F.when(F.size("hits") > 0, rest).otherwise(F.col(text_col)))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    out = leaks(docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


OP13_SQL = """
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase, least(len(w), 10) AS width
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM phrases),
starts AS (
  SELECT doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM lowered, widths WHERE len(w) >= width)),
found AS (SELECT s.doc_id, s.i, s.width, p.item_id FROM starts s JOIN phrases p ON s.width = p.width AND s.phrase = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, range(10) t(j) WHERE j < width GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT l.doc_id, len(l.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit ON l.doc_id = hit.doc_id LEFT JOIN item ON l.doc_id = item.doc_id
"""
