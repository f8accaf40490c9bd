"""Operator 5: HTML extraction with wrappers inferred from the pages of a host.

1. Every page becomes a token stream, and that a tree in which runs of equal siblings are folded into
   repeated groups. Only distinct folded trees of a host go on.
2. The trees of a host are aligned one after the other in chunks of bounded size, and the results
   again, until one is left: matching tags are merged, what only some have becomes optional, what repeats becomes a repeated
   group, and texts become slots. The result is the host's wrapper, a regular expression without
   unions.
3. What the slots hold, summed over all pages of the host, tells their parts. A text that nearly all
   pages have is the wrapper's own, no slot's content. By characters, and characters in links, the
   article is an article or main element that holds most of the unlinked text, else the smallest
   part outside repeated groups that does.
4. Each page is read by its host's wrapper: blocks of the article's slots, without the wrapper's own
   texts and the parts that are no article text by their tag, role or class. A page without that part
   of the wrapper is read by its own article and main elements.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, skew_join, tune

#: Hosts up to which the (small) rows of decisions are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: Distinct trees that are aligned at once, about: a host with more of them takes more rounds.
FAN = 64
#: For the wrapper alone: deeper elements count for their last ancestor above; of more siblings, equal ones
#: count as one repeated group wherever they stand; longer lists are aligned without backtracking.
DEEP, WIDE, CELLS = 64, 128, 40_000
#: A text is the wrapper's own if this share of a host's pages have it, these counted without copies and at least so many.
OWN_SHARE, OWN_PAGES = 0.9, 10

# Names of HTML elements, and words in class, id and role that mark other than article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form menu dialog button select option textarea iframe object svg canvas audio video map input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist replies disqus respond pagination pager toolbar".split()
)
AD, AD_PLACE = frozenset("ad ads adv".split()), frozenset("slot unit box banner container wrap wrapper block top bottom side left right inline mobile desktop google label space zone area 0".split())
TALK = frozenset("reviews feedback discussion guestbook".split())
NEUTRAL = frozenset("user users reader readers customer customers visitor visitors list lists section area item items link links buttons button bar icons icon form thread count author body post posts site page main more".split())
HEADERS = frozenset(["header"])
ARTICLE = frozenset(["article", "main"])
BARRIER_P = frozenset("article section div td li table".split())
BARRIER_LIST = frozenset("ul ol dl table menu select".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_GAP = re.compile(r"[\s/]*")


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) with kinds open, close and text; comments and declarations are left out.

    Attributes are read one by one, so a quote counts only after an equals sign. A "<" that begins no
    tag is text. References are decoded in each run of text alone.
    """
    at, size, text = 0, len(page), 0
    while at < size:
        begin = page.find("<", at)
        follow = page[begin + 1 : begin + 3] if begin >= 0 else ""
        if begin < 0:
            at = size
        elif not (follow[:1] in ("!", "?", "/") and follow[1:] or follow[:1].isalpha()):
            at = begin + 1
            continue
        if text < (stop := begin if begin >= 0 else size):
            yield "text", html.unescape(page[text:stop]), {}
        if begin < 0:
            return
        if follow[0] in "!?" or follow[0] == "/" and not follow[1].isalpha():
            end = {"<!--": "-->", "<![C": "]]>"}.get(page[begin : begin + 4], ">")
            at = text = (k + len(end) if (k := page.find(end, begin + 2)) >= 0 else size)
            continue
        m = _NAME.match(page, begin)
        if not m:
            # Letters beyond ASCII begin no tag.
            at, text = begin + 1, begin
            continue
        name, at, attrs = m[1].lower(), m.end(), {}
        while (at := _GAP.match(page, at).end()) < size and page[at] != ">":
            a = _ATTR.match(page, at)
            at = a.end()
            if follow[0] != "/":
                attrs.setdefault(a[1].lower(), html.unescape((a[2] or "").strip("\"'")))
        closed = page[at - 1] == "/"
        at = text = min(size, at + 1)
        if follow[0] == "/":
            yield "close", name, {}
            continue
        yield "open", name, attrs
        if name in RAW and not closed:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(page, at)
            yield "text", page[at : end.start()], {}
            yield "close", name, {}
            at = text = end.end()
    if text < size:
        yield "text", html.unescape(page[text:]), {}


def _noise(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is no article text by its tag, role, class or id.

    Of a class or id outside the article, the first or last word has to say so. In the article all of its words must be such ones
    or say where or whose something is, for there "share-price" and "social-history" are what the article is about. "ad"
    counts only beside words for a place.
    """
    if name in DROPPED or name in HEADERS and not inside or attrs.get("role", "").lower() in ROLES:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if name in ("html", "body", *ARTICLE):
        return False
    for value in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [re.sub("[0-9]+", "0", w.lower()) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", value)]
        if not words or {"has", "with", "no"} & set(words):
            continue
        ends = {words[0], words[-1], words[-2] if words[-1] == "0" and len(words) > 1 else words[-1]}
        if inside:
            if set(words) & (WORDS | AD | TALK) and set(words) <= WORDS | AD | AD_PLACE | TALK | NEUTRAL:
                return True
        elif ends & WORDS or ends & HEADERS or AD & set(words) and set(words) <= AD | AD_PLACE:
            return True
    return False


def _key(name: str, attrs: dict[str, str]) -> str:
    kind = (attrs.get("class") or attrs.get("id") or "").split()
    # Numbers, and words with digits, tell pages apart, not parts of a page.
    return f"{name}.{re.sub('[A-Za-z]*[0-9][A-Za-z0-9]*', '0', kind[0])}" if kind else name


class Open:
    """An open element, and what holds for the text in it."""

    __slots__ = ("name", "key", "noise", "inside", "article", "linked", "path", "depth")

    def __init__(self, name: str, attrs: dict[str, str], up: Open | None, root: str = ""):
        self.name, self.key = name, _key(name, attrs)
        self.noise = bool(up and up.noise) or _noise(name, attrs, bool(up and up.inside))
        self.article = bool(up and up.article) or name in ARTICLE
        self.inside = bool(up and up.inside) or self.article
        self.linked = bool(up and up.linked) or name == "a"
        self.path, self.depth = (up.path, up.depth) if up else ("", 0)
        if name not in INLINE:
            self.depth += 1
            if self.depth <= DEEP:
                self.path = f"{self.path}/{self.key}" if self.path else self.key
                self.inside |= bool(root) and self.path == root


def walk(page: str, root: str = "") -> Iterator[tuple[str, list[Open], str]]:
    """Token stream with the open elements: events open, close, text; closes what HTML closes by itself. root: the article's path, if known."""
    stack: list[Open] = []
    count: dict[str, int] = defaultdict(int)

    def close_to(k: int) -> Iterator[tuple[str, list[Open], str]]:
        while len(stack) > k:
            yield "close", stack, stack[-1].name
            count[stack.pop().name] -= 1

    def nearest_open(name: str, barrier: frozenset[str]) -> int:
        """Place of the innermost element of that name with no barrier in it; -1 if there is none."""
        if count[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    return k
                if stack[k].name in barrier:
                    break
        return -1

    for kind, name, attrs in tokens(page):
        if kind == "text":
            yield "text", stack, name
        elif kind == "open":
            k = nearest_open("p", BARRIER_P) if name in CLOSES_P else nearest_open(name, BARRIER_LIST) if name in ("li", "dt", "dd", "tr", "td", "th", "option") else -1
            if k >= 0:
                yield from close_to(k)
            stack.append(Open(name, attrs, stack[-1] if stack else None, root))
            count[name] += 1
            yield "open", stack, name
            if name in VOID:
                yield from close_to(len(stack) - 1)
        elif (k := nearest_open(name, frozenset())) >= 0:
            yield from close_to(k)
    yield from close_to(0)


def fold(nodes: list) -> list:
    """Siblings with runs of one key merged into one repeated node. A node: [key, optional, repeated, children]."""
    out: list = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            out[-1] = [n[0], out[-1][1] or n[1], True, align(out[-1][3], n[3])]
        else:
            out.append(n)
    if len(out) > WIDE:
        by: dict[str, list] = {}
        for n in out:
            had = by.get(n[0])
            by[n[0]] = [n[0], had[1] or n[1], True, align(had[3], n[3])] if had else n
        out = list(by.values())
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common sequence; of a common one, taken as it comes, where the lists are long."""
    if len(a) * len(b) > CELLS:
        where: dict[str, list[int]] = defaultdict(list)
        for i, x in enumerate(a):
            where[x].append(i)
        pairs, i = [], 0
        for j, x in enumerate(b):
            k = bisect_left(where[x], i) if x in where else 0
            if x in where and k < len(where[x]) and where[x][k] - i <= WIDE:
                pairs.append((where[x][k], j))
                i = pairs[-1][0] + 1
        return pairs
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def align(a: list, b: list) -> list:
    """Two lists of nodes as one: a common sequence of keys is merged, the rest becomes optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for x, y in [*_common([n[0] for n in a], [n[0] for n in b]), (len(a), len(b))]:
        out += [[n[0], True, n[2], n[3]] for n in a[i:x]] + [[n[0], True, n[2], n[3]] for n in b[j:y]]
        if x < len(a):
            out.append([a[x][0], a[x][1] or b[y][1], a[x][2] or b[y][2], align(a[x][3], b[y][3])])
        i, j = x + 1, y + 1
    return fold(out)


def shown(nodes: list) -> str:
    """A wrapper as a regular expression: # is a text slot, + repeats, ? is optional."""
    return " ".join(n[0] + (f"({shown(n[3])})" if n[3] else "") + {(0, 0): "", (0, 1): "+", (1, 0): "?", (1, 1): "*"}[int(n[1]), int(n[2])] for n in nodes)


def _line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _name_of(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\n".join(parts)) - 2**63


def read_page(page: str) -> tuple[str, dict[str, list[int]], list[int]]:
    """The folded tree of a page as JSON, for each slot path that isn't noise [characters, characters in links], and the hashes of its blocks."""
    root: list = ["", False, False, []]
    open_, slots, parts, blocks, path = [root], defaultdict(lambda: [0, 0]), [], [], ""

    def flush() -> None:
        if text := _line(parts):
            blocks.append(_name_of(path, text))
        parts.clear()

    for kind, stack, value in walk(page):
        if kind == "text":
            top = stack[-1] if stack else None
            if value.strip():
                if not (open_[-1][3] and open_[-1][3][-1][0] == "#"):
                    open_[-1][3].append(["#", False, False, []])
            if not (top and top.noise):
                parts.append(value)
                path = top.path if top else ""
                if size := len("".join(value.split())):
                    slot = slots[top.path if top else ""]
                    slot[0] += size
                    slot[1] += size * bool(top and top.linked)
        elif value == "br":
            parts.append(" ")
        elif value not in INLINE:
            flush()
            if stack[-1].depth > DEEP:
                continue
            if kind == "open":
                open_.append([stack[-1].key, False, False, []])
                open_[-2][3].append(open_[-1])
            else:
                node = open_.pop()
                node[3] = fold(node[3])
    flush()
    return json.dumps(fold(root[3])), slots, blocks


def single_parts(nodes: list, above: str = "") -> set[str]:
    """The paths of a wrapper's elements that are in no repeated group."""
    out: set[str] = set()
    for key, _, repeated, children in nodes:
        if key != "#" and not repeated:
            path = f"{above}/{key}" if above else key
            out |= {path} | single_parts(children, path)
    return out


def article_root(wrapper: list, slots: dict[str, tuple[int, int]]) -> str:
    """The path of the article: an outermost article or main element, else the deepest path with most unlinked text.

    A repeated group is a list of an article's parts, not the article.
    """
    own: dict[str, int] = defaultdict(int)
    for path, (chars, linked) in slots.items():
        parts = path.split("/")
        for k in range(len(parts) + 1):
            own["/".join(parts[:k])] += max(0, chars - linked)
    total = own.get("", 0)
    named = [p for p in own if p and p.split("/")[-1].split(".")[0] in ARTICLE and own[p] * 2 > total]
    if named:
        return min(named, key=lambda p: (p.count("/"), p))
    leaf = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "table", "tbody", "dl", "dd", "dt", "figure", "figcaption"}
    single = single_parts(wrapper)
    good = [p for p in own if p in single and own[p] * 10 >= total * 8 and p.split("/")[-1].split(".")[0] not in leaf]
    return max(good, key=lambda p: (p.count("/"), p), default="")


def extract(page: str, root: str, own: frozenset[int] = frozenset()) -> str:
    """The article's blocks in page order, joined by \\n.

    The part at the path root counts, even if it holds no text, less blocks of nothing but links at its two ends
    that are the wrapper's own: a text that all of a host's articles have is theirs, however many pages there are.
    Only where the page lacks that part (or the host has none) its article and main elements count, and without any
    the whole body but for the wrapper's own texts.
    """
    until, present, path, plain = 0, False, "", False
    placed, named, rest = [[], []], [[], []], [[], []]
    edges: list[bool] = []

    def flush() -> None:
        nonlocal plain
        for to in (placed, named, rest):
            if text := _line(to[1]):
                mine = bool(own) and _name_of(path, text) in own
                if to is placed:
                    edges.append(mine and not plain)
                if to is not rest or not mine:
                    to[0].append(text)
            to[1] = []
        plain = False

    for kind, stack, value in walk(page, root):
        if kind == "text":
            top = stack[-1] if stack else None
            if top and top.noise:
                continue
            rest[1].append(value)
            path = top.path if top else ""
            plain |= not (top and top.linked) and not value.isspace()
            if until:
                placed[1].append(value)
            if top and top.article:
                named[1].append(value)
        elif value == "br":
            for to in (placed, named, rest):
                to[1].append(" ")
        elif value not in INLINE:
            flush()
            if kind == "open":
                if not until and root and stack[-1].path == root and stack[-1].depth <= DEEP:
                    until, present = len(stack), True
            elif until and len(stack) <= until:
                until = 0
    flush()
    if not present:
        return "\n".join(named[0] or rest[0])
    # Links that all pages have before or after the article's own blocks.
    first = next((k for k, edge in enumerate(edges) if not edge), len(edges))
    last = next((k for k in range(len(edges), first, -1) if not edges[k - 1]), first)
    return "\n".join(placed[0][first:last])


def host_of(url: str) -> Column:
    """The host in a column of addresses; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _readings(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, tree, slots, page, blocks) of every page: folded tree, slot sums, and hashes (of path and text) of all its blocks and of each."""
    tune(pages.sparkSession)
    kind = pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64()), ("linked", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, slots, names, blocks = [], [], [], []
            for page in batch.column("html"):
                tree, sums, hashes = read_page(page.as_py() or "")
                trees.append(tree)
                slots.append([{"path": p, "chars": c, "linked": i} for p, (c, i) in sums.items()])
                names.append(_name_of(",".join(map(str, hashes))))
                blocks.append(sorted(set(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string()), pa.array(slots, kind), pa.array(names, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], ["host", "tree", "slots", "page", "blocks"])

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, "host string, tree string, slots array<struct<path:string,chars:long,linked:long>>, page long, blocks array<long>")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, root, own): a host's wrapper as a union-free regular expression, the path of its article, and the hashes of the wrapper's own texts.

    Null pages are empty ones, and a url that is null or has no host belongs to the host "".
    """

    def one(trees: list[str]) -> str:
        wrapper: list = []
        for k, tree in enumerate(sorted(trees)):
            wrapper = align(wrapper, json.loads(tree)) if k else json.loads(tree)
        return json.dumps(wrapper)

    def aligned(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host")[:1], "tree": pa.array([one(table.column("tree").to_pylist())])})

    def rooted(trees: pa.Table, slots: pa.Table) -> pa.Table:
        wrapper = json.loads(one(trees.column("tree").to_pylist()))
        sums = {p: (c, i) for p, c, i in zip(*(slots.column(x).to_pylist() for x in ("path", "chars", "linked")), strict=True)}
        return pa.table({"host": trees.column("host")[:1], "wrapper": pa.array([shown(wrapper)]), "root": pa.array([article_root(wrapper, sums)])})

    read = checkpoint(_readings(pages, url_col, html_col))
    trees = read.select("host", "tree").distinct()
    while True:
        sizes = trees.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= FAN:
            break
        chunk = F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") * 2 / FAN))
        trees = checkpoint(skew_join(trees, sizes, ["host"]).withColumn("chunk", chunk).groupBy("host", "chunk").applyInArrow(aligned, "host string, tree string").distinct())
    slots = read.select("host", F.explode("slots").alias("s")).groupBy("host", "s.path").agg(F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"))
    roots = trees.groupBy("host").cogroup(slots.groupBy("host")).applyInArrow(rooted, "host string, wrapper string, root string")
    unlike = read.groupBy("host", "page").agg(F.first("blocks").alias("blocks"))
    many = unlike.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= OWN_PAGES)
    often = unlike.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= OWN_PAGES)
    own = skew_join(often, many, ["host"]).where(F.col("n") >= OWN_SHARE * F.col("pages")).groupBy("host").agg(F.array_sort(F.collect_list("block")).alias("own"))
    return roots.join(own, "host", "left").select("host", "wrapper", "root", F.coalesce("own", F.array().cast("array<long>")).alias("own"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the article of every page; empty where there is none. Repeated rows are each kept."""
    tune(pages.sparkSession)
    wrappers = checkpoint(infer_wrappers(pages, url_col, html_col)).select("host", "root", "own")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    both = rows.join(F.broadcast(wrappers), "host", "left") if wrappers.count() <= BROADCAST_HOSTS else skew_join(rows, wrappers, ["host"], "left")
    kind = rows.schema["id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(x.as_py() or "", r.as_py() or "", frozenset(o.as_py() or ())) for x, r, o in zip(*(batch.column(c) for c in ("html", "root", "own")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["id", "url", "text", "n_chars"])

    return both.select("id", "url", "html", "root", "own").mapInArrow(made, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
