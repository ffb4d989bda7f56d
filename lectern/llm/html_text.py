"""HTML extraction by maximum-scoring subsequence.

A page is a sequence of tags and text runs. Words score above zero, tags below, by log odds
learnt from labelled pages: those of a bounded sample whose ``article`` or ``main`` element
marks the content. Elements that are page furniture (by tag, or by a name in class, id or role
that the labelled pages show outside the content; for names they don't show, by the prior
``FURNITURE``) are left out before the scan, so they cut nothing apart. One linear scan finds
the contiguous region of the highest total; the region widens to the innermost container
around it, or, where that is the whole page, to the page's parts that it touches. All text of
it is returned, block by block, without the furniture inside.

No name can veto the page itself. ``main`` is never furniture, nor is a form around an article.
Elements that a name took away are weighed once, largest first: one that only the prior took is
given back if it has ``MORE`` times the words left beside it, one that the labelled pages speak
against, that names readers' remarks, or that is a form, if next to nothing (``LEAST``) is left.

Defined cases: a null page counts as empty; a page without words gives an empty text; unclosed
and stray tags, quotes and comments are tolerated, in linear time and memory whatever the
length or depth; scripts, styles and comments are never text; character references are decoded
once; without labelled pages words score 1 and tags -0.5; equal scores keep the earliest
region; repeated rows are judged alike; an empty table gives an empty result. Columns of the
input are kept whatever their names, but for html and for text and n_chars, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages that the weights are fitted on, and the longest taken.
SAMPLE, SAMPLE_BYTES = 500, 100_000
#: Share of a page's words that names must leave, times the words left that the prior may take at most; words of a name seen before it has a weight.
LEAST, MORE, SEEN = 0.05, 3, 20

RAW = frozenset("script style template noscript iframe svg textarea select object annotation annotation-xml".split())
CONTAINERS = frozenset("article main section div td body html head nav header footer aside form".split())
NEVER = frozenset("head nav footer aside button dialog menu".split())
READERS = frozenset("comment comments reply replies respond disqus".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption blockquote pre br hr figure figcaption address title fieldset legend option details summary button dialog menu".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: The prior: names of furniture, names of place and form that say nothing, and words that turn a name into a remark on the page.
FURNITURE = frozenset("ad ads advert adverts advertisement advertisements adv sponsor sponsored promo promotion sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup login search comment comments reply replies disqus respond related share sharing social widget complementary contentinfo".split())
NEUTRAL = frozenset("left right top bottom inner outer box list item items block area section wrap wrapper container row col column bar panel header head title body content main primary secondary site page post posts article articles blog global buttons button links link form group unit slot zone ".split())
REMARK = frozenset("has no with without is show hide js layout".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STOP = re.compile(r"[\"'>]")


@dataclass
class Weights:
    tags: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)  #: of a word of a class, id or role
    tag: float = -0.5
    word: float = 1.0
    linked: float = 0.2  #: of a word in a link


def attributes(rest: str) -> tuple[list[str], bool]:
    """The class, id and role of a tag, lower-cased, and whether it is hidden: by the attribute of that name, to readers, or by its own style."""
    named, hidden = [], False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            named.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value.strip() == "true"):
            hidden = True
        elif name == "style":
            rules = (rule.partition(":") for rule in value.split(";"))
            hidden = hidden or any(k.strip() == "display" and v.split()[:1] == ["none"] for k, _, v in rules)
    return named, hidden


class Page:
    """A page as runs (text, tag, node, new block, in a link) over a tree of its containers in the order they open."""

    def __init__(self, html: str):
        self.runs: list[tuple[str, str, int, bool, bool]] = []
        self.tag, self.parent, self.names, self.hidden, self.last = [""], [0], [[]], [False], [0]
        stack, boxes = [0], [0]  # open nodes, and the places of containers among them
        places: dict[str, list[int]] = {}  # of open nodes by tag
        block, link = True, False
        for kind, name, rest in tokens(html):
            if kind == "text":
                self.runs.append((rest, "", stack[-1], block, link))
                block = False
                continue
            block = block or name in BLOCKS
            self.runs.append(("", name, stack[-1], block, link))
            link = name == "a" and kind == "open" if name == "a" or name in CONTAINERS else link
            if kind == "close":
                at = places[name][-1] if places.get(name) else -1
                if at > 0 and (name in CONTAINERS or at > boxes[-1]):
                    for node in stack[at:]:
                        self.last[node] = len(self.tag) - 1
                        places[self.tag[node]].pop()
                    del stack[at:]
                    while boxes[-1] >= at:
                        boxes.pop()
            elif name not in VOID and not rest.endswith("/"):
                named, hidden = attributes(rest) if rest and not rest.isspace() else ([], False)
                names = [[w for w in re.split(r"[^a-z0-9]+", one) if w] for x in named for one in x.split()]
                if name in CONTAINERS or names or hidden or name in NEVER:
                    places.setdefault(name, []).append(len(stack))
                    if name in CONTAINERS:
                        boxes.append(len(stack))
                    stack.append(len(self.tag))
                    for column, value in ((self.tag, name), (self.parent, stack[-2]), (self.names, names), (self.hidden, hidden), (self.last, 0)):
                        column.append(value)
        for node in stack:
            self.last[node] = len(self.tag) - 1

    def inside(self, tags: frozenset[str]) -> list[bool]:
        """Of each node, whether it or a node around it is one of tags."""
        out = [False] * len(self.tag)
        for k, name in enumerate(self.tag):
            out[k] = name in tags or (k > 0 and out[self.parent[k]])
        return out

    def furniture(self, weights: Weights) -> list[bool]:
        """Of each node, whether it is or lies in page furniture."""
        n = len(self.tag)
        words = [0] * n
        for text, _, node, _, _ in self.runs:
            if text:
                words[node] += len(text.split())
        for k in range(n - 1, 0, -1):
            words[self.parent[k]] += words[k]
        article = self.inside(frozenset(("article", "main")))
        around = [False] * n  # of each node, whether an article stands in it
        for k in range(n - 1, 0, -1):
            around[self.parent[k]] |= around[k] or self.tag[k] in ("article", "main")
        fixed = [t in NEVER or h or (t == "header" and not article[self.parent[k]]) for k, (t, h) in enumerate(zip(self.tag, self.hidden))]
        doubt = [0.0] * n  # of nodes that a name takes: the words left, in units of its own, up to which it is given back
        for k in range(1, n):
            if self.tag[k] == "form":
                doubt[k] = 0.0 if around[k] else LEAST / (1 - LEAST)
            if self.tag[k] not in ("html", "body", "main"):
                for one in self.names[k]:
                    if named_so(one, weights):
                        sure = any(w in READERS or w in weights.names for w in one)
                        given = LEAST / (1 - LEAST) if sure else 1 / MORE
                        doubt[k] = min(doubt[k], given) if doubt[k] else given
        taken = [fixed[k] or doubt[k] > 0 for k in range(n)]
        above, below, own = [0] * n, {}, words[:]  # the nearest node around that is taken, those right below each, words outside of them
        for k in range(1, n):
            p = self.parent[k]
            above[k] = p if taken[p] else above[p]
            if taken[k]:
                below.setdefault(above[k], []).append(k)
                own[above[k]] -= words[k]
        left, rank = own[0], [(-words[k], k) for k in below.get(0, ()) if not fixed[k]]
        heapify(rank)
        while rank:
            _, k = heappop(rank)
            if words[k] and left <= doubt[k] * words[k]:
                taken[k], left = False, left + own[k]
                for x in below.get(k, ()):
                    if not fixed[x]:
                        heappush(rank, (-words[x], x))
        out = [False] * n
        for k in range(1, n):
            out[k] = out[self.parent[k]] or taken[k]
        return out


def named_so(words: list[str], weights: Weights) -> bool:
    """Whether a class, id or role, as its words, names furniture."""
    if not words or words[0] in REMARK or any(w in REMARK for w in words[:-1]):
        return False
    known = [weights.names[w] for w in words if w in weights.names]
    if len(known) == len(words):
        return min(known) <= -1
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in NEUTRAL or w.isdigit() for w in words)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(text, '', characters), (open, tag, attributes) or (close, tag, ''), in one pass."""
    at, begin, size = 0, 0, len(html)
    quotes = True
    while (at := html.find("<", at)) >= 0:
        after = html[at + 1 : at + 2]
        closing = after == "/"
        name = _NAME.match(html, at + 1 + closing)
        if not name and after not in ("!", "?", "/"):
            at += 1  # a bare sign is text
            continue
        if at > begin:
            yield "text", "", html[begin:at]
        if not name:
            mark = "-->" if html.startswith("<!--", at) else ">"
            end = html.find(mark, at + 2)
            begin = at = end + len(mark) if end >= 0 else size
            continue
        tag = name[0].lower()
        end = _tag_end(html, name.end()) if quotes else html.find(">", name.end())
        if end < 0 and quotes:  # a quote that swallows the rest is none
            quotes, end = False, html.find(">", name.end())
        if end < 0:
            return
        rest = html[name.end() : end]
        begin = at = end + 1
        if tag in RAW and not closing:
            if not rest.endswith("/") or tag in ("script", "style"):
                shut = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(html, at)
                end = html.find(">", shut.end()) if shut else -1
                begin = at = end + 1 if end >= 0 else size
            continue
        yield ("close", tag, "") if closing else ("open", tag, rest)
    if begin < size:
        yield "text", "", html[begin:]


def _tag_end(html: str, at: int) -> int:
    """Where the tag's > stands, outside quoted values; -1 if it has none."""
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        before = html[max(0, m.start() - 8) : m.start()].rstrip()
        if before.endswith("="):
            shut = html.find(m[0], m.end())
            if shut < 0:
                return -1
            at = shut + 1
        else:
            at = m.end()
    return -1


def region(gains: list[float]) -> tuple[int, int]:
    """First and past-last place of the contiguous region with the highest total, (0, 0) if none is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, gain in enumerate(gains):
        if total <= 0:
            total, start = 0.0, k
        total += gain
        if total > best:
            best, found = total, (start, k + 1)
    return found


def gain(run: tuple[str, str, int, bool, bool], weights: Weights) -> float:
    text, tag, _, _, link = run
    return weights.tags.get(tag, weights.tag) if tag else len(text.split()) * (weights.linked if link else weights.word)


def main_text(html: str | None, weights: Weights) -> str:
    page = Page(html or "")
    never = page.furniture(weights)
    first, last = region([0.0 if never[r[2]] else gain(r, weights) for r in page.runs])
    nodes = [r[2] for r in page.runs[first:last] if r[0] and not r[0].isspace() and not never[r[2]]]
    if not nodes:
        return ""
    low, high = min(nodes), max(nodes)
    around = low
    while page.last[around] < high:
        around = page.parent[around]
    box = list(range(len(page.tag)))  # the container of each node
    for k in range(1, len(box)):
        if page.tag[k] not in CONTAINERS:
            box[k] = box[page.parent[k]]
    around = box[around]
    whole = page.tag[around] not in ("", "html", "body")
    if whole and page.tag[around] not in ("article", "main"):  # a box that holds the page's own furniture is the page
        whole = not any(page.parent[k] == around and page.tag[k] in ("nav", "header", "footer", "aside") for k in range(around + 1, page.last[around] + 1))
    spans = [(around, page.last[around])]
    if not whole:
        parts = {_part(page, k, around) for k in (nodes[0], nodes[-1])}
        spans = [(k, page.last[k]) for k in parts if k != around]
        near = lambda r: box[r[2]] == around or never[r[2]]
        while first > 0 and near(page.runs[first - 1]):  # text of no part of its own
            first -= 1
        while last < len(page.runs) and near(page.runs[last]):
            last += 1
    blocks: list[list[str]] = []
    new = True
    for k, (text, _, node, block, _) in enumerate(page.runs):
        new = new or block
        if text and not never[node] and ((not whole and first <= k < last) or any(a <= node <= b for a, b in spans)):
            if new:
                blocks.append([])
            blocks[-1].append(text)
            new = False
    joined = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def _part(page: Page, node: int, around: int) -> int:
    """The child of around that holds node; around itself if none does."""
    while node != around and page.parent[node] != around:
        node = page.parent[node]
    return node


def learn(pages: list[str]) -> Weights:
    """Log odds of tags, of linked words and of names, content against the rest, smoothed and clipped."""
    tags, names, words = ({c: Counter() for c in (False, True)} for _ in range(3))
    for html in pages:
        page = Page(html)
        marked = page.inside(frozenset(("article", "main")))
        if not any(r[0].strip() and marked[r[2]] for r in page.runs):
            continue
        of: list[frozenset] = [frozenset()] * len(page.tag)
        for k in range(1, len(page.tag)):  # names around each node
            own = {w for x in page.names[k] for w in x}
            of[k] = of[page.parent[k]] | own if own else of[page.parent[k]]
        for text, tag, node, _, link in page.runs:
            if tag:
                tags[marked[node]][tag] += 1
            elif size := len(text.split()):
                words[marked[node]][link] += size
                for w in of[node]:
                    names[marked[node]][w] += size
    if not words[True]:
        return Weights()
    odds = lambda seen, k: log((seen[True][k] + 1) / (seen[False][k] + 1))
    known = {w for c in names.values() for w in c if names[True][w] + names[False][w] >= SEEN}
    return Weights(
        {k: min(max(odds(tags, k), -1.5), 0.0) - 0.2 for c in tags.values() for k in c},
        {w: min(max(odds(names, w), -3.0), 3.0) for w in known},
        -0.5,
        1.0,
        min(max(odds(words, True), -1.0), 0.5),
    )


def fit(pages: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Weights:
    """Weights from at most ``sample`` pages of at most ``sample_bytes`` that mark their content."""
    marked = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.octet_length("html") <= sample_bytes))
    marked = marked.select(F.xxhash64("html").alias("h"), "html")
    last = marked.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Weights()
    # equal pages count once, so no more than sample pages reach the driver
    rows = marked.where(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return learn([r.html for r in rows])


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """pages without html, with text and n_chars (its code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit(pages))  # a few numbers a tag or name
    kept = [k for k, n in enumerate(pages.columns) if n not in ("html", "text", "n_chars")]
    plain = pages.toDF(*[f"c{k}" for k in range(len(pages.columns))])  # no name can clash
    html = F.col(f"c{pages.columns.index('html')}").cast("string").alias("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), shared.value) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f"c{k}" for k in kept), "text", "n_chars"])

    schema = T.StructType([*(plain.schema[k] for k in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = plain.select(*[f"c{k}" for k in kept], html).mapInArrow(run, schema)
    return out.toDF(*[pages.columns[k] for k in kept], "text", "n_chars")
