"""Operator 2: SentencePiece encoding and decoding with a max-plus parallel scan.

Texts up to a chunk's size are encoded by the library, a batch at a time. A giant text is cut into
chunks at fixed positions, and one long run of characters can cross a cut, so a chunk can't be
encoded without its neighbours. Instead:

1. States. A cut's states are the pieces that end on it or span it (just the cut itself where a word
   begins on it, as no piece crosses the start of a word).
2. Transfer. Each chunk, alone, gives the matrix of its best scores from each state of its left cut to
   each of its right cut (-inf: no way). A BPE model allows a piece after another exactly if the merges
   of their joined text give these two pieces again; the only way through is the library's own
   result, so a way scores 0.
3. Scan. The max-plus product of matrices is associative: the products of FAN neighbours, of FAN such
   products, and so on are made each by a task of its own, up to one matrix a text; on the way down,
   the states at the ends of a product tell those at the cuts within it.
4. Backtrace. Each chunk, alone, finds its pieces between its two states: the broken words at its cuts by their ways, what is
   between two starts of words by the library.

Chunks are rows of their own and are spread over the cluster; only the small matrices of a text meet.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, tune

CHUNK, FAN = 32_768, 16
_LOADED: dict[str, "Pieces"] = {}


class Pieces:
    """The parts of a BPE model that steps 1 to 4 need."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.score))
        self.pair = lru_cache(1 << 20)(self._pair)

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def normal(self, text: str) -> str:
        """The text as the model sees it: normalised, spaces as U+2581."""
        return self.library.normalize(text).replace(" ", "▁") if text else ""

    def merges(self, text: str) -> list[str]:
        """The model's merges on a short text: the best adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, k = max(((self.score.get(parts[i] + parts[i + 1], (-np.inf,))[0], -i) for i in range(len(parts) - 1)))
            if best == -np.inf:
                break
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
        return parts

    def _pair(self, a: str, b: str) -> bool:
        return self.merges(a + b) == [a, b]

    def plain(self, text: str) -> list[int]:
        """Ids of normalised text between two starts of words: the library's own, which puts the first space back."""
        if text[0] == "▁" and self.normal(text[1:].replace("▁", " ")) == text:
            return self.library.encode(text[1:].replace("▁", " "), num_threads=1)
        return [i for w in re.findall("▁*[^▁]+|▁+", text) for way in self.ways(w, (0, 0), len(w), True).values() for i in self.ids([w[x:y] for x, y in way])]

    def at(self, text: str, begin: int, end: int) -> Iterator[str]:
        """Pieces of text from begin, none longer than to end; a character that is no piece is one."""
        yield text[begin]
        for stop in range(begin + 2, min(begin + self.longest, end) + 1):
            if text[begin:stop] in self.score:
                yield text[begin:stop]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The pieces (begin, end) that reach over or up to a cut, or the cut itself at a word's start or an end."""
        if cut in (0, len(text)) or text[cut] == "▁" != text[cut - 1]:
            return [(cut, cut)]
        return sorted({(b, b + len(p)) for b in range(max(0, cut - self.longest), cut) for p in self.at(text, b, len(text)) if b + len(p) >= cut and self.merges(p) == [p]})

    def ways(self, text: str, start: tuple[int, int], cut: int, last: bool) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Of the states of the cut on the right, those that can be reached from start, each with its pieces."""
        begin, end = start
        back: dict[tuple[int, int], tuple[int, int] | None] = {start: None}
        ends = {end: [start]}
        for at in range(end, cut):
            for before in ends.pop(at, ()):
                left = text[before[0] : before[1]]
                for piece in self.at(text, at, len(text)):
                    node = (at, at + len(piece))
                    if node not in back and (not left or self.pair(left, piece)) and self.merges(piece) == [piece]:
                        back[node] = before
                        ends.setdefault(node[1], []).append(node)
        out = {}
        for node in [x for e, xs in ends.items() for x in xs if e >= cut]:
            way, x = [], node
            while x != start:
                way.append(x)
                x = back[x]
            out[node] = way[::-1]
        if last:
            out = {(cut, cut): way for node, way in out.items() if node[1] == cut}
        return out

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids; a character that is no piece becomes its bytes."""
        return [i for p in pieces for i in ([self.score[p][1]] if p in self.score else [self.library.piece_to_id(f"<0x{b:02X}>") for b in p.encode()])]


def cuts(text: str, chunk: int, at_words: bool = True) -> list[int]:
    """Where a normalised text is cut: every chunk characters, or (at_words) up to a quarter later at a word's start."""
    out, at = [0], chunk
    while at < len(text):
        m = re.compile(r"(?<=[^▁])▁").search(text, at, min(len(text), at + chunk // 4)) if at_words else None
        out.append(m.start() if m else at)
        at = out[-1] + chunk
    return [*out, len(text)]


_START = re.compile(r"(?<=[^▁])▁")


def inner(text: str, a: int, b: int, left: list, right: list) -> tuple[int, int] | None:
    """The first and last start of a word in a chunk between cuts a and b (a cut of one state counts): between them there is one way alone."""
    first = a if left == [(a, a)] else (m.start() if (m := _START.search(text, a)) else len(text))
    last = b
    if right != [(b, b)]:
        last = text.rfind("▁", first, b + 1)
        while last > first and text[last - 1] == "▁":
            last = text.rfind("▁", first, last)
    return (first, last) if first <= last else None


def transfer(pieces: Pieces, text: str, a: int, b: int) -> list[list[float]]:
    """The max-plus matrix of the chunk between cuts a and b; text holds as much around it as a piece is long.

    Only the broken words at the cuts have several states: the matrix is the product of the left one's column and the right one's row.
    """
    left, right = pieces.states(text, a), pieces.states(text, b)
    if (within := inner(text, a, b, left, right)) is None:
        last = right == [(b, b)]
        return [[0.0 if y in got else -np.inf for y in right] for x in left for got in [pieces.ways(text, x, b, last)]]
    first, last = within
    head = [[0.0]] if left == [(a, a)] else [[0.0 if pieces.ways(text, x, first, True) else -np.inf] for x in left]
    tail = [[0.0]] if right == [(b, b)] else [[0.0 if y in got else -np.inf for y in right] for got in [pieces.ways(text, (last, last), b, False)]]
    return product([head, tail])


def trace(pieces: Pieces, text: str, a: int, b: int, x: int, y: int) -> list[int]:
    """The ids of the chunk between its states x and y: the broken words by their ways, the words between by the library."""
    left, right = pieces.states(text, a), pieces.states(text, b)
    if (within := inner(text, a, b, left, right)) is None:
        return pieces.ids([text[i:j] for i, j in pieces.ways(text, left[x], b, right == [(b, b)])[right[y]]])
    first, last = within
    head = [] if left == [(a, a)] else pieces.ways(text, left[x], first, True)[first, first]
    tail = [] if right == [(b, b)] else pieces.ways(text, (last, last), b, False)[right[y]]
    return pieces.ids([text[i:j] for i, j in head]) + (pieces.plain(text[first:last]) if first < last else []) + pieces.ids([text[i:j] for i, j in tail])


def product(matrices: list[list[list[float]]]) -> list[list[float]]:
    """The max-plus product of matrices of neighbouring chunks."""
    out = np.array(matrices[0])
    for m in matrices[1:]:
        out = (out[:, :, None] + np.array(m)[None]).max(1)
    return out.tolist()


def path_of(matrices: list[list[list[float]]], x: int, y: int) -> list[int]:
    """The state at each cut on the best way through the chunks, from state x on the left to y on the right."""
    reach = [np.where(np.arange(len(matrices[0])) == x, 0.0, -np.inf)]
    for m in matrices:
        reach.append((reach[-1][:, None] + np.array(m)).max(0))
    if reach[-1][y] == -np.inf:
        raise ValueError("no way through the chunks: the model has pieces across words, or isn't a BPE model")
    k = [y]
    for m, r in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        k.append(int((r + np.array(m)[:, k[-1]]).argmax()))
    return k[::-1]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, at_words: bool = True, fan: int = FAN) -> DataFrame:
    """(id, ids array<int>): exactly the library's ids of each row's whole text; null and empty texts have none.

    model: path of a SentencePiece BPE model without pieces across words. at_words: cut at starts of
    words where there are any near by. Every input row has one output row, repeated rows too. Extra
    columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Pieces.load(model).library
        for batch in batches:
            got = sp.encode([x or "" for x in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.list_(pa.int32()))], ["id", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.load(model)
        for batch in batches:
            for key, row, raw in zip(batch.column("id"), batch.column("row"), batch.column("text"), strict=True):
                text = p.normal(raw.as_py())
                at, span = cuts(text, chunk, at_words), 2 * p.longest
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    # What stands around the chunk; the text's own ends stay recognisable.
                    low, high = max(0, a - span), min(len(text), b + span)
                    yield pa.RecordBatch.from_pydict({"id": pa.array([key.as_py()], batch.schema.field("id").type), "row": [row.as_py()], "k": pa.array([k], pa.int32()), "a": pa.array([a - low], pa.int32()), "b": pa.array([b - low], pa.int32()), "body": [text[low:high]]})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.load(model)
        for batch in batches:
            out = [json.dumps(transfer(p, t, a, b)) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("body", "a", "b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(out, pa.string())], ["row", "k", "m"])

    def combined(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        m = product([json.loads(x) for x in table.column("m").to_pylist()])
        return pa.table({"row": table.column("row")[:1], "k": table.column("g")[:1], "m": pa.array([json.dumps(m)])})

    def opened(matrices: pa.Table, ends: pa.Table) -> pa.Table:
        matrices = matrices.sort_by("k")
        states = path_of([json.loads(x) for x in matrices.column("m").to_pylist()], ends.column("x")[0].as_py(), ends.column("y")[0].as_py())
        return pa.table({"row": matrices.column("row"), "k": matrices.column("k"), "x": pa.array(states[:-1], pa.int32()), "y": pa.array(states[1:], pa.int32())})

    def scan(matrices: DataFrame) -> DataFrame:
        """(row, k, x, y): the states at the left and right cut of each chunk."""
        levels, n = [checkpoint(matrices)], (matrices.agg(F.max("k")).first()[0] or 0) + 1
        group = F.floor(F.col("k") / fan).cast("int").alias("g")
        while n > 1:
            levels.append(checkpoint(levels[-1].select("row", "k", group, "m").groupBy("row", "g").applyInArrow(combined, "row long, k int, m string")))
            n = -(-n // fan)
        states = levels.pop().select("row", "k", F.lit(0).alias("x"), F.lit(0).alias("y"))
        for level in reversed(levels):
            ends = states.toDF("row", "g", "x", "y").groupBy("row", "g")
            states = level.select("row", "k", group, "m").groupBy("row", "g").cogroup(ends).applyInArrow(opened, "row long, k int, x int, y int")
        return states

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.load(model)
        for batch in batches:
            out = [trace(p, t, a, b, x, y) for t, a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("body", "a", "b", "x", "y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(out, pa.list_(pa.int32()))], ["row", "k", "part"])

    giant = F.length("text") > chunk
    chunks = rows.where(giant).withColumn("row", F.monotonically_increasing_id()).mapInArrow(split, f"id {kind}, row long, k int, a int, b int, body string")
    # Row numbers depend on how the input is dealt out; written once, they hold when a task runs again.
    chunks = checkpoint(chunks.repartition("row", "k"))
    states = scan(chunks.mapInArrow(measured, "row long, k int, m string"))
    parts = chunks.join(states, ["row", "k"]).mapInArrow(traced, "row long, k int, part array<int>")
    whole = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("ids"))
    names = chunks.where("k = 0").select("row", "id")
    return rows.where(F.coalesce(~giant, F.lit(True))).mapInArrow(short, f"id {kind}, ids array<int>").unionByName(names.join(whole, "row").select("id", "ids")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null or no ids give an empty text."""
    tune(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Pieces.load(model).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([sp.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(told, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256) of every document, giant ones through the scan."""
    from public_tokenizers import path

    model = path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Cut wherever a chunk ends, in the middle of words too: the matrices decide.
    encoded = encode(docs, model, at_words=False)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Pieces.load(model).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array([sp.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    out = encoded.mapInArrow(told, f"doc_id {kind}, ids array<int>, text string")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))
