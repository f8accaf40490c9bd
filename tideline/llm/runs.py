"""Operator 11: periodic runs, by a suffix automaton with link-cut access.

Each text is told alone, in the task that holds it. Words that a run of exponent 4 can't contain, because they are
too rare in their stretch of the text, separate stretches (again and again, until nothing changes). For each
stretch a suffix automaton is built; its suffix links form a tree, kept as a link-cut tree: a preferred path
holds the suffixes with one last occurrence. Appending a word accesses the state of the prefix it ends:
every path segment on the way to the root tells where suffixes up to its length ended before, and is recoloured with the
new end. If the distance d of the two ends is within the segment's length, the last 2 d words are a square;
the length beyond d extends it to the whole run with period d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import gathered, text_bytes, tune, word_hashes

#: Words of a run at least, and periods in it at least.
SHORTEST, PERIODS = 6, 4
#: Bytes of text that a task looks at together; a longer text is alone.
SLICE = 2 << 20


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string, state of each prefix) of the suffix automaton; state 1 is the root."""
    link, length, follow, ends = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for w in words:
        here = len(length)
        length.append(length[last] + 1)
        link.append(1)
        follow.append({})
        p = last
        while p and w not in follow[p]:
            follow[p][w] = here
            p = link[p]
        if p:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                while p and follow[p].get(w) == q:
                    follow[p][w] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
        ends.append(here)
    return link, length, ends


class LastEnds:
    """Link-cut tree over the suffix links: each preferred path has one colour, the end of its last occurrence.

    A preferred path is a splay tree ordered by depth; its colour stays at the tree's root.
    """

    def __init__(self, link: list[int]):
        self.up, self.low, self.high, self.colour = link[:], [0] * len(link), [0] * len(link), [0] * len(link)

    def splay(self, x: int) -> None:
        """Makes x the root of its path's tree, which keeps its colour."""
        up, low, high = self.up, self.low, self.high
        root = x
        while (p := up[root]) and (low[p] == root or high[p] == root):
            root = p
        colour, end = self.colour[root], up[root]
        while (p := up[x]) != end:
            if (g := up[p]) != end:
                self._turn(p if (low[g] == p) == (low[p] == x) else x, g if (low[g] == p) == (low[p] == x) else p)
            self._turn(x, up[x])
        self.colour[x] = colour

    def _turn(self, x: int, p: int) -> None:
        """Rotates x over its parent p in the tree."""
        up, low, high = self.up, self.low, self.high
        g = up[p]
        if g:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x
        if low[p] == x:
            b = low[p] = high[x]
            high[x] = p
        else:
            b = high[p] = low[x]
            low[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g

    def access(self, x: int, end: int) -> list[tuple[int, int]]:
        """(former end, deepest state) of each coloured segment between x and the root, all recoloured with end."""
        out, below = [], 0
        while x:
            self.splay(x)
            colour = self.colour[x]
            if colour:
                out.append((colour, x))
            if self.high[x]:
                self.colour[self.high[x]] = colour
            self.high[x] = below
            below, x = x, self.up[x]
        self.colour[below] = end
        return out


def runs_of(words: list[int], shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period; periods is 2 or more."""
    link, length, states = automaton(words)
    ends, n, out = LastEnds(link), len(words), []
    for i, state in enumerate(states):
        # Ends count from 1: colour 0 is none.
        for before, deepest in ends.access(state, i + 1):
            d, same = i + 1 - before, length[deepest]
            if same + d >= shortest and same >= (periods - 1) * d and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                out.append((i + 1 - same - d, same + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, text: np.ndarray, shortest: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, number of its stretch) of all words that may lie in a run.

    In a run every word occurs once a period. So a stretch is cut at words that occur fewer than periods times in it,
    until none is left, or it is too short.
    """
    at, group = np.arange(len(words)), text
    while len(at):
        order = np.lexsort((words[at], group))
        w, g = words[at][order], group[order]
        new = np.append(True, (w[1:] != w[:-1]) | (g[1:] != g[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(w)))
        kept = np.empty(len(at), bool)
        kept[order] = np.repeat(count >= periods, count)
        at, group = at[kept], group[kept]
        fresh = np.append(True, (np.diff(at) > 1) | (np.diff(group) != 0))[: len(at)]
        number = np.cumsum(fresh) - 1
        size = np.bincount(number) if len(at) else number
        long = (size >= shortest)[number] if len(at) else number.astype(bool)
        if kept.all() and long.all():
            return at, group
        at, group = at[long], number[long]
    return at, group


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed): one row a document, repeated rows and null ids too.

    Words are runs of bytes other than ASCII white space; words are equal when 64 bits of their hashes are. A run
    is a stretch with smallest period q of shortest words and periods * q words at least that no neighbouring word
    extends; runs are (start, length, period) by start, then period. collapsed: the words joined by
    one space, without those that some run has after its first q. Null and empty texts have no words.
    """
    tune(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SLICE):
            words, text = word_hashes(*text_bytes(batch.column("text")))
            begin = np.searchsorted(text, np.arange(batch.num_rows + 1))
            at, group = stretches(words, text, shortest, periods)
            kinds = np.unique(words[at], return_inverse=True)[1]
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(at) else np.zeros(1, int)
            of: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                r = int(text[at[a]])
                shift = int(at[a] - begin[r])
                of[r] += [(s + shift, n, p) for s, n, p in runs_of(kinds[a:b].tolist(), shortest, periods)]
            collapsed = []
            for r, value in enumerate(batch.column("text")):
                kept, upto, whole = [], 0, (value.as_py() or "").encode().split()
                for low, high in sorted((s + p, s + n) for s, n, p in of[r]):
                    kept += whole[upto:low]
                    upto = max(upto, high)
                collapsed.append(b" ".join(kept + whole[upto:]).decode())
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in of]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(begin), pa.int64()), pa.array(rows, kind), pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def looped(doc_id: Column, text: Column) -> Column:
    """Text of which, for a tenth of the ids, every word from some place on repeats the words there: runs to be found."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def joined(x: Column) -> Column:
        words, g = x["words"], F.floor(h / 10)
        n = F.size(words).cast("long")
        made = F.transform(F.array(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))), lambda y: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < y["a"], i).otherwise(y["a"] + (i - y["a"]) % y["p"]).cast("int"))))
        return F.array_join(F.get(made, 0), " ")

    # Bound as elements of arrays of one: an expression inside a lambda function would be evaluated for every word.
    out = F.get(F.transform(F.array(F.struct(words.alias("words"))), lambda x: F.when(F.size(x["words"]) > 0, joined(x)).otherwise(text)), 0)
    return F.when(h % 10 == 0, out).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
