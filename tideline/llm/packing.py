"""Operator 6: packing token sequences as vector bins.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Tasks fill
one sequence at a time from a bounded pool of remainders: of the pieces that fit, the one whose
demand has the largest dot product with the room that is left goes in; when none fits, one is cut to
fill the room. A sequence that can't be filled is cut back to a power of two, which needs no padding,
and its tail returns to the pool. Each task packs what it scans: no shuffle, and the pool is bounded
whatever the size of the input. Sequence numbers join the task's partition with a count, so a task
that runs again gives the same rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import tune

MAX_TOKENS, MAX_SEGMENTS, POOL, END = 2048, 128, 384, 1
#: Bytes of parts and their ids that a worker remembers, about; longer parts (in characters) are not remembered.
REMEMBERED, LONG = 96 << 20, 64


# After lower-casing, the letters of Basic Latin to Latin Extended-A; and texts in which these are all
# the letters, no character changes by normalisation and lower case doesn't depend on the context.
_LETTER, _BLANK = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", " \t\n\r\x0b\x0c"
_OTHER = re.compile("[^\x00-\x7f\u00a0-\u012f\u0131-\u017f]")
_RUN = re.compile(f"[{_LETTER}]+")
_PARTS = re.compile(f"[{_LETTER}]+|[^{_LETTER}{_BLANK}]+")
_QUOTED = re.compile(f"[^{_BLANK}']*'[^{_BLANK}]*|[{_LETTER}]+|[^{_LETTER}{_BLANK}]+")


class WordIds(dict):
    """Ids of a text by its parts, each encoded once while it is remembered.

    Exact for tokenizers that lower-case, drop white space, and never join letters with other
    characters but in contractions. Parts are runs of letters or of other characters (whole words
    where there is an apostrophe); a text with letters beyond Latin Extended-A is taken by words.
    """

    loaded: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Byte-level models name the printable bytes by their own character, the others by 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        probes = ("a", "the", "straße", "éàœ", "zzyzxqj")
        self.direct = all(self.letters(x) == self.whole(x) for x in probes)
        self.bytes = 0

    @classmethod
    def load(cls, path: str) -> WordIds:
        """One for each worker process, so that its tasks share what it remembers."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def whole(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def letters(self, part: str) -> list[int]:
        """Ids of a run of lower-case letters, which needs the model's merges alone."""
        return [x.id for x in self.tokenizer.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.byte))]

    def __missing__(self, part: str) -> bytes:
        ids = self.letters(part) if self.direct and _RUN.fullmatch(part) else self.whole(part)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= LONG:
            if self.bytes >= REMEMBERED:
                self.clear()
                self.bytes = 0
            self[part] = out
            self.bytes += 160 + 2 * len(part) + len(out)
        return out

    def of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _OTHER.search(text) or "<|" in text:
            # The line feed, which is dropped, keeps these apart from runs of lower-case letters.
            parts = ["\n" + x for x in text.replace("\n", " ").split(" ")]
        else:
            parts = (_QUOTED if "'" in text else _PARTS).findall(text.lower())
        return b"".join(map(self.__getitem__, parts))


class _Packer:
    """Fills sequences from a pool of remainders. Rows of the pool: item, start, tokens, loss."""

    def __init__(self, limits: tuple[int, int, int], first: int):
        self.limits, self.next = np.array(limits, float), first
        self.pool = np.zeros((0, 4), np.int64)
        # An item: key, the ids that are not yet in a sequence, the number of the first of these, of all, and of loss-bearing ones.
        self.items: dict[int, tuple[object, bytes, int, int, int]] = {}
        self.left: dict[int, int] = {}
        self.rows: list[tuple] = []

    def loss(self, item: int, start: int, size: int) -> int:
        """Loss-bearing tokens of a piece: those of an item are its last ones."""
        quiet = self.items[item][3] - self.items[item][4]
        return max(0, start + size - max(start, quiet))

    def add(self, item: int, key: object, ids: bytes, n_loss: int) -> None:
        n, most = len(ids) // 4, int(self.limits[0])
        self.items[item], self.left[item] = (key, ids, 0, n, n_loss), n
        start = 0
        while n - start >= most and self.loss(item, start, most) <= self.limits[2]:
            self.put([(item, start, most)])
            start += most
        if start < n:
            self.items[item] = (key, ids[4 * start :], start, n, n_loss)
            self.pool = np.vstack([self.pool, [(item, start, n - start, self.loss(item, start, n - start))]])

    def put(self, pieces: list[tuple[int, int, int]]) -> None:
        at = 0
        for item, start, size in pieces:
            key, ids, base, n, _ = self.items[item]
            self.rows.append((key, start, size, zlib.crc32(ids[4 * (start - base) : 4 * (start - base + size)]), n, self.next, at))
            at += size
            self.left[item] -= size
            if not self.left[item]:
                del self.left[item], self.items[item]
        self.next += 1

    def fill(self) -> None:
        """One sequence."""
        room, pieces = self.limits.copy(), []
        while len(self.pool) and room[0] >= 1 and room[1] >= 1:
            need = np.column_stack([self.pool[:, 2], np.ones(len(self.pool)), self.pool[:, 3]])
            fits = (need <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (need / self.limits) @ (room / self.limits), -1)
                row = int(score.argmax())
                item, start, size, _ = map(int, self.pool[row])
                self.pool = np.delete(self.pool, row, 0)
            else:
                row = int(self.pool[:, 2].argmax())
                item, start, whole, _ = map(int, self.pool[row])
                size = int(min(room[0], whole))
                if (over := self.loss(item, start, size) - int(room[2])) > 0:
                    size -= over
                if size <= 0:
                    break
                if size == whole:
                    self.pool = np.delete(self.pool, row, 0)
                else:
                    self.pool[row] = item, start + size, whole - size, self.loss(item, start + size, whole - size)
            pieces.append((item, start, size))
            room -= (size, 1, self.loss(item, start, size))
        total = sum(x[2] for x in pieces)
        if total < self.limits[0] and total & (total - 1):
            keep = 1 << (total.bit_length() - 1)
            kept, back = [], []
            for item, start, size in pieces:
                take = min(size, keep)
                keep -= take
                kept += [(item, start, take)] * (take > 0)
                back += [(item, start + take, size - take, self.loss(item, start + take, size - take))] * (size > take)
            pieces, self.pool = kept, np.vstack([self.pool, back])
        self.put(pieces)


def pack_sequences(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Pieces: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    encode: called once in a task; gives the function from a text to its ids as little-endian
    unsigned 32-bit bytes. The end id 1 follows each text, so that a null or empty text is one token
    and no row is lost; a null id stays null; rows that repeat an id are packed each. loss_col: how
    many of a row's last tokens bear loss (null or absent: all). Extra columns are ignored; an empty
    table gives an empty result. Every id is in exactly one piece,
    pieces of a sequence lie side by side, and a sequence is full or a power of two long.
    """
    spark = docs.sparkSession
    tune(spark)
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    kind = docs.schema[id_col].dataType.simpleString()
    loss = f"cast(`{loss_col}` as int)" if loss_col else "cast(null as int)"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, k, schema = encode(), _Packer(limits, TaskContext.get().partitionId() << 40), 0, None

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            schema = batch.schema.field("id").type
            for key, text, n_loss in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("loss").to_pylist(), strict=True):
                ids = ids_of(text.as_py() or "") + END.to_bytes(4, "little")
                packer.add(k, key, ids, len(ids) // 4 if n_loss is None else max(0, min(n_loss, len(ids) // 4)))
                k += 1
                while len(packer.pool) >= POOL or packer.pool[:, 2].sum() > POOL * max_tokens:
                    packer.fill()
            yield out()
        while len(packer.pool):
            packer.fill()
        if packer.rows:
            yield out()

    rows = docs.selectExpr(f"`{id_col}` id", f"`{text_col}` text", f"{loss} loss")
    return rows.mapInArrow(packed, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def word_encoder(path: str) -> Callable[[], Callable[[str], bytes]]:
    return lambda: WordIds.load(path).of


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations under three limits at once: tokens, pieces, and loss-bearing tokens (those of the assistant)."""
    from public_tokenizers import path

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("struct(conv_id, turn) doc_id", "text", "if(role = 'assistant', null, 0) n_loss")
    out = pack_sequences(turns, word_encoder(path("word_bpe_49k.json")), loss_col="n_loss", max_loss=MAX_TOKENS * 3 // 4)
    return out.select("doc_id.*", *out.columns[1:])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_encoder(path("word_bpe_49k.json")))
