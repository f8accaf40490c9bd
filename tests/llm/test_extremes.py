"""Extreme sizes: many covered lines, vectors at the ends of the doubles, many languages."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import language_id, nearest
from tideline.llm.line_dedup import drop_lines


def test_many_covered_lines(frame):
    r = random.Random(1)
    lines = [f"line {k} {r.random()}" for k in range(200_000)]
    own = ["", "own", ""]
    docs = frame((1, "\n".join(lines)), (2, "\n".join([*own, *lines, "end"])))
    began = time.time()
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in drop_lines(docs).collect()}
    assert got == {1: ("\n".join(lines), 200_000, 0), 2: ("\n".join([*own, "end"]), 200_004, 200_000)}
    assert time.time() - began < 60


def products(ids, mantissas, powers, k):
    """By integers: exact, then rounded to a double (beyond them: infinite or 0)."""
    def score(a, b):
        n = int(mantissas[a] @ mantissas[b])
        try:
            return math.ldexp(n, powers[a] + powers[b])
        except OverflowError:
            return math.copysign(math.inf, n)

    return {q: sorted(((-score(q, i), i) for i in ids if i != q))[:k] for q in ids if q % 20 == 0}


def test_vectors_of_any_magnitude(spark):
    r = np.random.default_rng(2)
    ids = list(range(300))
    mantissas = r.integers(-50, 51, (300, 4))
    mantissas[:, 0] |= 1
    for draw in (lambda: 0, lambda: 660, lambda: -660, lambda: 1000, lambda: -1060, lambda: int(r.choice([-900, -660, 0, 3, 400, 660])), lambda: int(r.integers(-40, 40))):
        powers = [draw() for _ in ids]
        rows = [(i, np.ldexp(mantissas[i].astype(float), powers[i]).tolist(), "x") for i in ids]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string")
        got = {}
        for x in nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20, factor=1.0, shard_rows=40, block_queries=10, pivots=6).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((-x.score, x.vec_id))
        assert got == products(ids, mantissas, powers, 20), powers[:5]


def test_eighty_languages(spark):
    r = random.Random(3)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(80)]

    def text(k):
        return " ".join("".join(r.choice(alphabets[k]) for _ in range(r.randint(3, 8))) for _ in range(60))

    docs = spark.createDataFrame([(i, text(i % 80), f"l{i % 80:02}", f"h{i % 7}") for i in range(1600)], "doc_id long, text string, lang string, source string")
    out = language_id.identify(docs, language_id.fit(docs), declared=F.col("lang"), host=F.col("source"), carry=["lang"])
    assert out.where("language <> lang or not kept").isEmpty()


def test_headings_of_all_articles_stay(spark):
    """However many pages a host has; only links at the article's ends that all pages have go, and class words in it need company."""
    from tideline.llm import html_text

    def page(k):
        odd = '<section id="social-history"><p>Social</p></section><p class="share-price">Price</p><div class="related-work"><p>Related</p></div><p class="comment-on-law">Law</p>'
        talk = '<div class="user-reviews"><p>Great</p><p>Bad</p></div><div class="reader-feedback"><p>Hm</p></div><div class="ad-slot">Buy</div>'
        return f"<html><body><nav>Menu</nav><article><p><a href='/'>Start</a></p><h1>Title {k}</h1><h2>Summary</h2><p>{'word ' * 30}{k}</p><h2>Conclusion</h2><p>end {k}</p>{odd}{talk}<p><a href='/next'>All articles</a></p></article><footer>Foot</footer></body></html>"

    for n in (9, 10, 30):
        pages = spark.createDataFrame([(k, "https://h.example/" + str(k), page(k)) for k in range(n)], "page_id long, url string, html string")
        for r in html_text.extract_text(pages).collect():
            k = r.page_id
            body = [f"Title {k}", "Summary", "word " * 30 + str(k), "Conclusion", f"end {k}", "Social", "Price", "Related", "Law"]
            links = ["Start", *body, "All articles"]
            assert r.text.split("\n") == (body if n >= html_text.OWN_PAGES else links), (n, r.text)
