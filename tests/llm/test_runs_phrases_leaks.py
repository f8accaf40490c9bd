"""Operators 11 to 13 against brute force, with null, empty, repeated, very long and clashing rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import collocations as co
from tideline.llm import decontamination as de
from tideline.llm import runs as ru

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_runs(w, shortest=6, periods=4):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(shortest, periods * q) and not any(w[i : i + n - x] == w[i + x : i + n] for x in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic(r):
    """Words of few kinds with powers among them."""
    w = [str(r.randrange(r.randint(1, 4))) for _ in range(r.randint(0, 25))]
    for _ in range(r.randint(0, 3)):
        root = [str(r.randrange(3)) for _ in range(r.randint(1, 6))]
        w += (root * 9)[: r.randint(0, 45)] + [f"u{r.randrange(9)}" for _ in range(r.randrange(4))]
    return w


def test_runs_of_words():
    r = random.Random(1)
    for _ in range(800):
        w = periodic(r)
        ids = [hash(x) for x in w]
        assert ru.runs_of(ids) == brute_runs(ids)
    # A run in the first period of another, and one that begins in another.
    w = ([0] * 7 + [1, 2, 3]) * 5
    assert ru.runs_of(w) == brute_runs(w) and len(brute_runs(w)) == 6


def test_suffix_automaton_and_link_cut_access():
    """Every access tells, for each suffix of the prefix, where it ended last."""
    r = random.Random(2)
    for _ in range(60):
        w = [r.randrange(3) for _ in range(r.randint(1, 40))]
        link, length, states = ru.automaton(w)
        assert [length[s] for s in states] == [*range(1, len(w) + 1)]
        ends = ru.LastEnds(link)
        for i, s in enumerate(states):
            told = ends.access(s, i + 1)
            for n in range(1, i + 2):
                before = [k for k in range(n, i + 1) if w[k - n : k] == w[i + 1 - n : i + 1]]
                covering = [c for c, deepest in reversed(told) if length[deepest] >= n]
                assert (covering[0] if covering else None) == (before[-1] if before else None)


def test_periodic_runs(frame):
    r = random.Random(3)
    rows = [(i, " ".join(periodic(r))) for i in range(150)]
    long = " ".join([str(r.randrange(10**6)) for _ in range(3000)] + [f"x{k % 2500}" for k in range(20000)])
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a a a a a a"), (203, "a a a a a a"), (203, "a a a a a a"), (204, "a A a A\ta\nA a A"), (205, long), (206, "é é é é é é é"), (207, "a a a a a")]
    got = {(x.doc_id, x.n_words, tuple((y.start, y.length, y.period) for y in x.runs), x.collapsed) for x in ru.periodic_runs(frame(*rows)).collect()}
    want = set()
    for i, t in rows:
        w = (t or "").split()
        runs = brute_runs(w) if i != 205 else [(3000, 20000, 2500)]
        want.add((i, len(w), tuple(runs), collapsed(w, runs)))
    assert got == want and sum(len(x[2]) for x in got) > 100
    assert ru.periodic_runs(frame(*rows)).count() == len(rows)
    assert ru.periodic_runs(frame(*rows).limit(0)).isEmpty()


def test_op11(spark, tmp_path, frame):
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(30)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 160)))) for i in range(300)] + [(400, None), (401, " ".join(periodic(r)))]
    frame(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.asDict() for x in ru.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    found = 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        found += bool(runs)
        assert got[i] == {
            "doc_id": i, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": runs and 1000 * best[1] // best[2] or None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(w, runs).encode()).hexdigest(),
        }
    assert found > 10


def brute_phrases(rows, top, least, inside):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * b >= inside * a for q, b in cand.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, k, p.decode(), -a, x, y, totals[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(rest)[:top], 1)]
    return sorted(out)


def test_equal_partitions(monkeypatch):
    r = np.random.default_rng(5)
    for small in (4, 1 << 15):
        monkeypatch.setattr(co, "SMALL", max(small, 120))
        keys = [r.integers(0, k, 5000).astype(np.uint64) for k in (3, 20, 40)]
        weights = r.integers(1, 4, 5000)
        for least in (1, 9):
            head, count = co.equal_partitions(keys, weights, least)
            want = Counter()
            for row, w in zip(zip(*(k.tolist() for k in keys), strict=True), weights.tolist(), strict=True):
                want[row] += w
            assert {tuple(int(k[h]) for k in keys): int(n) for h, n in zip(head, count, strict=True)} == {k: n for k, n in want.items() if n >= least}
            assert len(head) == len({*head.tolist()})


@pytest.mark.parametrize("hold", [300, 8 << 20])
def test_collocations(spark, monkeypatch, hold):
    monkeypatch.setattr(co, "HOLD", hold)
    r = random.Random(6)
    kinds = ["the", "of", "New", "york", "CITY", "É", "é", "x-y", " ", "a\x00b"] + [f"w{k}" for k in range(30)]
    rows = []
    for i in range(400):
        text = ""
        for _ in range(r.randint(0, 120)):
            text += r.choice(["New York city", "of the", *kinds]) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?"])
        rows.append((r.choice(["en", "de", None, "und", ""]), text, i, "x", 1))
    rows += [("en", None, 1, "x", 1), (None, "", 2, "x", 1), ("fr", "once", 3, "x", 1), ("en", "the of " * 20000, 4, "x", 1)] + [("en", "the same row again and again", 5, "x", 1)] * 12
    docs = spark.createDataFrame(rows, "lang string, text string, h1 int, word string, f int")
    for top, least, inside in ((2000, 10, 50), (5, 3, 90)):
        got = sorted(tuple(x) for x in co.collocations(docs, top=top, least=least, inside=inside).collect())
        assert got == brute_phrases([(x[0], x[1]) for x in rows], top, least, inside) and len(got) > 15
    assert co.collocations(docs.limit(0)).isEmpty()


def test_scores_pass_64_bits(spark):
    a, x, y = 3 * 10**12, 4 * 10**12 + 1, 7 * 10**12 + 3
    assert spark.range(1).select(co.score(F.lit(a), F.lit(x), F.lit(y))).first()[0] == 10**6 * a * a // (x * y)


def test_fm_index():
    r = random.Random(7)
    for _ in range(40):
        n, kinds = r.randint(0, 200), r.randint(1, 5)
        text = np.array([r.randint(0, kinds) for _ in range(n)], np.int64)
        index = de.FMIndex(text, kinds)
        for size in (1, 2, 4):
            phrases = np.array([[r.randint(1, kinds) for _ in range(size)] for _ in range(15)])
            got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(*index.search(phrases), strict=True)}
            want = {k: [i for i in range(n - size + 1) if (text[i : i + size] == p).all()] for k, p in enumerate(phrases)}
            assert got == {k: v for k, v in want.items() if v}


def brute_leaks(docs, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w and i is not None else 0):
            phrases.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    sizes = {len(p) for p in phrases}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := phrases.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= p
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "shard", "symbols"), [(100_000, 4 << 20, 1 << 20), (60, 2000, 64)])
def test_leaks(spark, frame, monkeypatch, block, shard, symbols):
    for name, value in (("SHARD", shard), ("SYMBOLS", symbols)):
        monkeypatch.setattr(de, name, value)
    r = random.Random(8)
    kinds = [f"w{k}" for k in range(60)] + ["É", "naïve", "K"]
    items = [(k, " ".join(r.choice(kinds) for _ in range(r.randint(8, 25)))) for k in range(30)]
    items += [(40, items[0][1]), (40, items[0][1]), (41, "one-two THREE"), (42, None), (43, ""), (44, " .,"), (None, "w1 w2"), (45, "w1 w1 " * 12), (46, "rare")]
    docs = []
    for i in range(200):
        parts = [" ".join(r.choice(kinds) for _ in range(r.randint(0, 40))) for _ in range(3)]
        text = r.choice(items[:31])[1].upper() if i % 3 == 0 else "w1 w1 w1 " * 9
        docs.append((i, f"{parts[0]}; {text}\n{parts[1]}" + (f" One Two, three {parts[2]}" if i % 7 == 0 else "")))
    docs += [(300, None), (301, ""), (302, "..."), (None, items[3][1]), (303, items[3][1]), (303, items[3][1]), (304, "one two. Three"), (305, "rare"), (306, (items[5][1] + " zz ") * 900)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, phrase int")
    out = de.leaks(frame(*docs), bench, block=block)
    rows = out.collect()
    got = sorted(((x.doc_id, x.n_words, sum(h.end - h.begin for h in x.hits), tuple(x.items)) for x in rows), key=str)
    assert got == brute_leaks(docs, items) and sum(x[2] > 0 for x in got) > 60
    for x in rows:
        for a, b in zip(x.hits, x.hits[1:], strict=False):
            assert a.end < b.begin
        for h in x.hits:
            assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.text.translate(LOWER)[: h.high])[h.begin :] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.text.translate(LOWER)[h.low : h.high])
    cut = {x.doc_id: x.text for x in de.cut_leaks(frame(*docs), bench, block=block).collect()}
    assert cut[300] is None and cut[301] == "" and cut[302] == "..." and cut[303] == "" and cut[304] == ""
    assert "zz" in cut[306] and items[5][1] not in cut[306]
    assert de.leaks(frame(*docs).limit(0), bench).isEmpty()
    none = de.leaks(frame(*docs), bench.limit(0))
    assert none.count() == len(docs) and none.where(F.size("hits") + F.size("items") > 0).isEmpty()
